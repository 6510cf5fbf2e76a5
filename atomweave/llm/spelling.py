"""Spelling variants by finite-state composition: words at one edit from each other, and the form that each stands for.

Words are counted over all texts.  Two words at one edit share the first or the last letters of at least half of the
shorter one, so each word is dealt to the partitions of its beginning and of its end (read backwards), for its own length
and for the next shorter one.  A partition is what the vocabulary's acceptor holds below one state: its words, built into
a minimised acceptor of their own, are composed with a transducer of exactly one insertion, deletion or replacement and
with the acceptor again.  Paths on which both acceptors are in one state come before the edit; after it they must read the
same letters to the end.  A pair is found in one partition only.

A word's form is its near word of the largest count, if that is RATIO times its own or more; equal counts go to the least
word.  Roots follow forms to the last by pointer doubling; counts at least double on the way, so there are few rounds.

One occurrence in SLIPS of a word in a text loses a letter on purpose, chosen by the crc32 of key and word, as a test of
misspellings; ``slips=None`` leaves words as they are.

Defined results: null and empty texts have no words; runs of letters of any length are taken whole; a null key counts as
an empty one, and rows that repeat a key are counted each.  An empty table gives no rows.  Other columns aren't looked at,
whatever their names.
"""

from __future__ import annotations

import sys
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from atomweave.llm.common import BROADCAST_ROWS, slices, small_batches, staged, utf8
from atomweave.llm.words import LOWER, SPACED, words

#: Code points of a word and occurrences in all texts, at least; how much more often a form occurs.
LETTERS, LEAST, RATIO = 5, 3, 2
#: A run loses a letter where this divides the crc32 of key and run.
SLIPS = 97
#: Runs longer than this in bytes are hashed one by one.
LONG = 64

_CRC = np.zeros(256, np.uint32)
for _i in range(256):
    _c = _i
    for _ in range(8):
        _c = _c >> 1 ^ (0xEDB88320 if _c & 1 else 0)
    _CRC[_i] = _c

_ASCII = np.zeros(256, bool)
_ASCII[65:91] = _ASCII[97:123] = True


def letters(data: np.ndarray) -> np.ndarray:
    """UTF-8 bytes with spaces for all that isn't A-Z, a-z or U+00C0 to U+00FF, whose two bytes begin with C3."""
    inside = _ASCII[data]
    lead = data == 0xC3
    inside |= lead
    inside[1:] |= lead[:-1]
    return np.where(inside, LOWER[data], np.uint8(0x20))


def crcs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, state: np.ndarray) -> np.ndarray:
    """crc32 of each run of bytes after a beginning whose crc32 is ``state``."""
    size = ends - starts
    order = np.argsort(-np.minimum(size, LONG + 1), kind="stable")
    at, left = starts[order], size[order]
    crc = ~state.astype(np.uint32)[order]
    whole = int(np.searchsorted(-left, -LONG, "left"))  # those before are longer than LONG
    live = np.searchsorted(-left, -np.arange(1, LONG + 1), "right")  # how many have so many bytes or more
    for j in range(LONG):
        if live[j] <= whole:
            break
        part = slice(whole, live[j])
        crc[part] = _CRC[(crc[part] ^ data[at[part] + j]) & 0xFF] ^ crc[part] >> np.uint32(8)
    out = np.empty(len(order), np.uint32)
    out[order] = ~crc
    for i in order[:whole]:
        out[i] = zlib.crc32(data[starts[i] : ends[i]].tobytes(), int(state[i]))
    return out


def _strings(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The runs of bytes as a string column."""
    size = ends - starts
    offsets = np.concatenate([[0], np.cumsum(size)])
    taken = data[np.repeat(starts - offsets[:-1], size) + np.arange(offsets[-1])]
    return pa.LargeStringArray.from_buffers(len(size), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(taken))).cast(pa.string())


def vocabulary(docs: DataFrame, key: str = "doc_id", text: str = "text", slips: int | None = SLIPS) -> DataFrame:
    """(word, n): words of LETTERS code points or more that occur LEAST times or more."""
    small_batches(docs.sparkSession)

    def run(batches):
        for whole in batches:
            for batch in slices(whole, text, 2 << 20):
                raw, offsets = utf8(batch.column(1))
                data = letters(raw)
                hashes, starts, ends, rows = words(data, offsets, SPACED)
                slipped: dict[str, int] = {}
                if slips and len(starts):
                    begin = np.array([zlib.crc32(f"{'' if k is None else k}:".encode()) for k in batch.column(0).to_pylist()], np.uint32)
                    crc = crcs(data, starts, ends, begin[rows])
                    hit = crc % slips == 0
                    for i in np.flatnonzero(hit).tolist():
                        run = data[starts[i] : ends[i]].tobytes().decode()
                        cut = int(crc[i]) % len(run)
                        if len(run) > LETTERS:
                            run = run[:cut] + run[cut + 1 :]
                            slipped[run] = slipped.get(run, 0) + 1
                    hashes, starts, ends = hashes[~hit], starts[~hit], ends[~hit]
                # the second byte of a letter doesn't count
                second = np.concatenate([[0], np.cumsum((data & 0xC0) == 0x80)])
                long = ends - starts - (second[ends] - second[starts]) >= LETTERS
                _, first, n = np.unique(hashes[long], return_index=True, return_counts=True)
                found = [_strings(data, starts[long][first], ends[long][first]), pa.array(slipped.keys(), pa.string())]
                yield pa.RecordBatch.from_arrays([pa.concat_arrays(found), pa.array(np.concatenate([n, np.array(list(slipped.values()), np.int64)]).astype(np.int64))], ["word", "n"])

    counted = docs.select(F.col(key), F.col(text)).where(F.col(text).isNotNull()).mapInArrow(run, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST)


class Acceptor:
    """A minimised acceptor of words given in order; a state is its transitions and whether it accepts, and equal states are one."""

    def __init__(self, ordered: list[str]):
        self.next: list[dict[str, int]] = []
        self.final: list[bool] = []
        known: dict[tuple, int] = {}

        def settled(node: list) -> int:
            name = (node[1], tuple(node[0].items()))
            state = known.get(name)
            if state is None:
                state = known[name] = len(self.next)
                self.next.append(node[0])
                self.final.append(node[1])
            return state

        path: list[list] = [[{}, False]]
        last = ""
        for word in ordered:
            same = 0
            for a, b in zip(word, last):
                if a != b:
                    break
                same += 1
            for i in range(len(last), same, -1):
                path[i - 1][0][last[i - 1]] = settled(path.pop())
            path += [[{}, False] for _ in word[same:]]
            path[-1][1] = True
            last = word
        for i in range(len(last), 0, -1):
            path[i - 1][0][last[i - 1]] = settled(path.pop())
        self.root = settled(path[0])


def one_edit(acceptor: Acceptor, longest: int) -> list[tuple[str, str]]:
    """All pairs of accepted words, of up to ``longest`` letters, at exactly one edit; some more than once.

    Endings are chains (letter, ending), so that states share them, and words are put together for pairs found alone."""
    arcs, final = acceptor.next, acceptor.final
    held: dict[tuple[int, int], list] = {}
    pairs: dict[int, list] = {}

    def common(p: int, q: int) -> list:
        """The endings that both states accept."""
        name = (p, q) if p < q else (q, p)
        out = held.get(name)
        if out is None:
            a, b = arcs[p], arcs[q]
            out = [()] if final[p] and final[q] else []
            for c in a.keys() & b.keys():
                out += [(c, x) for x in common(a[c], b[c])]
            held[name] = out
        return out

    def below(q: int) -> list:
        """(letter, pair below) before the edit, (letters of the one, of the other, ending) at it."""
        out = pairs.get(q)
        if out is None:
            out = []
            own = list(arcs[q].items())
            for i, (c, s) in enumerate(own):
                out += [(c, x) for x in below(s)]
                out += [("", c, x) for x in common(s, q)]  # an insertion
                for d, t in own[i + 1 :]:
                    out += [(c, d, x) for x in common(s, t)]  # a replacement
            pairs[q] = out
        return out

    def spelt(pair: tuple) -> tuple[str, str]:
        before, after = [], []
        while len(pair) == 2:
            before.append(pair[0])
            pair = pair[1]
        one, other, rest = pair
        while rest:
            after.append(rest[0])
            rest = rest[1]
        head, tail = "".join(before), "".join(after)
        return head + one + tail, head + other + tail

    sys.setrecursionlimit(max(sys.getrecursionlimit(), 4 * longest + 1000))  # as deep as words are long
    return [spelt(x) for x in below(acceptor.root)]


def _found(name: str, rows: dict[str, int]) -> list[tuple[str, str, int, int]]:
    """(word, near, and their counts) of one partition: its name says the direction, the shorter length and the shared letters."""
    size, back = int(name[1 : name.index(":")]), name[0] == "b"
    share = (size - 1) // 2
    turned = {w[::-1]: w for w in rows} if back else dict.fromkeys(rows)
    pairs = set(one_edit(Acceptor([w[share:] for w in sorted(turned)]), size + 1))
    out = []
    beginning = next(iter(turned))[:share]
    for x, y in pairs:
        x, y = beginning + x, beginning + y
        if back:
            x, y = x[::-1], y[::-1]
            if x[:share] == y[:share]:
                continue  # found where words begin alike
        if len(x) == size and len(x) <= len(y):
            out.append((x, y, rows[x], rows[y]))
    return out


def near_words(known: DataFrame) -> DataFrame:
    """(word, near, near_n): every word of (word, n) with each word at one edit from it."""
    size = F.length("word")
    dealt = known.withColumn("size", F.explode(F.array_distinct(F.array(size, F.greatest(size - 1, F.lit(LETTERS)))))).withColumn("share", F.floor((F.col("size") - 1) / 2).cast("int"))
    name = lambda side, part: F.concat(F.lit(side), F.col("size").cast("string"), F.lit(":"), part)
    dealt = dealt.select("word", "n", F.explode(F.array(name("f", F.substr("word", F.lit(1), F.col("share"))), name("b", F.substr("word", size - F.col("share") + 1, F.col("share"))))).alias("partition"))

    def run(batches):
        held, group = None, {}
        found: list[tuple[str, str, int, int]] = []

        def made():
            out = pa.RecordBatch.from_arrays([pa.array([r[0] for r in found] + [r[1] for r in found], pa.string()), pa.array([r[1] for r in found] + [r[0] for r in found], pa.string()), pa.array([r[3] for r in found] + [r[2] for r in found], pa.int64())], ["word", "near", "near_n"])
            found.clear()
            return out

        for batch in batches:
            for name, word, n in zip(*(c.to_pylist() for c in batch.columns)):
                if name != held:
                    if len(group) > 1:
                        found += _found(held, group)
                    held, group = name, {}
                group[word] = n
            if len(found) > 50_000:
                yield made()
        if len(group) > 1:
            found += _found(held, group)
        yield made()

    # partitions lie together and in order, so that a task reads one after another
    return dealt.select("partition", "word", "n").repartition("partition").sortWithinPartitions("partition", "word").mapInArrow(run, "word string, near string, near_n long")


def group(docs: DataFrame, key: str = "doc_id", text: str = "text", slips: int | None = SLIPS) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for all words of the vocabulary."""
    known = staged(vocabulary(docs, key, text, slips))
    best = near_words(known).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("n"), F.col("near").alias("w"))).alias("b"))
    told = known.join(best, "word", "left").withColumn("b", F.when(-F.col("b.n") >= RATIO * F.col("n"), F.col("b")))
    told = staged(told.select("word", F.col("b.w").alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), (-F.col("b.n")).alias("form_n")))
    roots = told.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    while True:
        hop = roots.select(F.col("word").alias("root"), F.col("root").alias("further"))
        few = roots.count() <= BROADCAST_ROWS
        moved = staged(roots.join(F.broadcast(hop) if few else hop, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        roots = moved.select("word", "root")
        if moved.where("moved").isEmpty():
            break
    return told.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
