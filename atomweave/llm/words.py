"""Words and word shingles of UTF-8 batches as 64-bit hashes, without a Python object per word."""

from __future__ import annotations

import numpy as np

U64 = np.uint64
GOLDEN = U64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(32)
    x *= U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(32)
    x *= U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(32)
    return x


def byte_table(separators) -> np.ndarray:
    """True where a byte belongs to a word."""
    keep = np.ones(256, bool)
    keep[list(separators)] = False
    return keep


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Words split at white space, and words of ASCII letters, digits and all that isn't ASCII.
SPACED = byte_table([0x20, *range(0x09, 0x0E)])
ALNUM = byte_table([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])
_BYTE = mix(np.arange(1, 257, dtype=U64) * GOLDEN)


def powers(n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        out = np.full(n, U64(0xA24BAED4963EE407), U64)
        out[0] = 1
        return np.multiply.accumulate(out)


def words(data: np.ndarray, offsets: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first byte, end byte and row of every word; A-Z count as lower case."""
    n = len(data)
    if not n:
        return np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    low = LOWER[data]
    inside = keep[low]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    heads = offsets[:-1][offsets[:-1] < n]  # a word never runs over from one row to the next
    first[heads] |= inside[heads]
    starts = np.flatnonzero(first)
    if not len(starts):
        return np.zeros(0, U64), starts, starts, starts
    last = np.empty(n, bool)
    last[:-1] = inside[:-1] & ~inside[1:]
    last[-1] = inside[-1]
    tails = offsets[1:][offsets[1:] > 0] - 1
    last[tails] |= inside[tails]
    ends = np.flatnonzero(last) + 1
    value = _BYTE[low]
    value[~inside] = 0
    place = np.arange(n, dtype=np.int64)
    begin = np.zeros(n, np.int64)
    begin[starts] = starts
    place -= np.maximum.accumulate(begin)
    place[~inside] = 0
    value *= powers(int(place.max()) + 1)[place]
    hashes = mix(np.add.reduceat(value, starts) + (ends - starts).astype(U64))
    return hashes, starts, ends, np.searchsorted(offsets, starts, "right") - 1


def bounds(rows: np.ndarray, n: int) -> np.ndarray:
    """Offsets of each row's words in a list ordered by row."""
    return np.searchsorted(rows, np.arange(n + 1))


def shingles(hashes: np.ndarray, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-word shingles in order and their offsets by row; a row of fewer words has them all as one shingle."""
    counts = np.diff(at)
    per = np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
    out_at = np.concatenate([[0], np.cumsum(per)])
    out = np.zeros(out_at[-1], U64)
    total = len(hashes)
    if total >= k:
        rolled = np.zeros(total - k + 1, U64)
        for j in range(k):
            rolled = mix(rolled + GOLDEN) + hashes[j : total - k + 1 + j]
        rolled = mix(rolled)
        full = np.flatnonzero(counts >= k)
        if len(full):
            lengths = per[full]
            source = np.repeat(at[full] - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths) + np.arange(lengths.sum())
            target = np.repeat(out_at[full] - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths) + np.arange(lengths.sum())
            out[target] = rolled[source]
    for row in np.flatnonzero((counts > 0) & (counts < k)):
        own = np.array([counts[row]], U64)
        for h in hashes[at[row] : at[row + 1]]:
            own = mix(own + GOLDEN) + h
        out[out_at[row]] = mix(own)[0]
    return out, out_at
