"""Audio columns: chroma fingerprints and the alignment of recordings.

A recording (WAV, 16-bit PCM) becomes frames of twelve pitch classes by short Fourier transforms.  Rectangle
filters, read off the frames' integral image, compare neighbouring times and pitches; each gives two bits, sixteen make
a packed 32-bit integer for every frame.  Recordings of equal fingerprints are one class.

Classes are dealt out by hash to blocks, and every two blocks meet in a task.  There the integers of one block are looked
up among those of the other: each equal pair of places votes for the distance between them, so that two classes have an
offset histogram, and every offset with a vote is compared.  It's a link if the bits that differ over the common frames
are few; of several such offsets the one with the most votes is told.  All links between classes that share an integer
are found, in one pass.  A task sends on how many each class has, its best one and the least class that they lead to, so
what is sent doesn't grow with the square of a group.  Recordings that repeat
an integer very often get votes and wrong bits of all offsets by Fourier transforms, so steady tones of any length are
compared too.  Groups are the connected components; recall against comparing all pairs is in the README.

Defined results: null, empty, unreadable and too short recordings have an empty fingerprint and are linked with nothing;
silence is a fingerprint like others; recordings of any length count whole; an empty table gives an empty result.  A
vector's null components count as 0.  Stereo is averaged.  Equal votes go to the offset nearest 0, then to the smaller
one, as seen from the later class.  Repeated rows are answered each and are one class.  A row without a key is answered with its fingerprint and null
class and group.  Other columns aren't looked at, whatever their names.
"""

from __future__ import annotations

import io
import wave

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from atomweave.llm.common import staged
from atomweave.llm.graph import components

FRAME, HOP, PITCHES = 1024, 256, 12
LOW_HZ, HIGH_HZ = 60.0, 3600.0
#: Frames that the widest filter spans, least common frames and greatest share of bits that differ.
SPAN, LEAST_FRAMES, MOST_ERROR = 16, 8, 0.25
#: Frames of a block and least number of blocks; places and frames that are compared at once in a task.
BLOCK_FRAMES, BLOCKS, AT_ONCE = 500_000, 8, 1_000_000


def filters() -> list[tuple[str, int, int, int, int]]:
    """Sixteen filters (kind, frames, first pitch, pitches, shift), from rules: kinds in turn, widths doubling, bands moving on."""
    return [(("time", "pitch", "cross", "band")[i % 4], (4, 8, 12, SPAN)[i // 4], (5 * i) % PITCHES, 2 + 2 * (i % 3), i) for i in range(16)]


def samples(wav: bytes | None) -> tuple[np.ndarray, int]:
    """Mono samples from -1 to 1 and their rate."""
    if not wav:
        return np.zeros(0), 1
    try:
        with wave.open(io.BytesIO(wav)) as f:
            rate, channels, width = f.getframerate(), f.getnchannels(), f.getsampwidth()
            raw = f.readframes(f.getnframes())
    except (wave.Error, EOFError):
        return np.zeros(0), 1
    if width != 2 or not rate or not channels:
        return np.zeros(0), 1
    x = np.frombuffer(raw[: len(raw) // (2 * channels) * 2 * channels], "<i2").reshape(-1, channels).mean(1)
    return x / 32768.0, rate


def chroma(x: np.ndarray, rate: int) -> np.ndarray:
    """Energy of the twelve pitch classes in each frame, each frame's summing to 1."""
    n = (len(x) - FRAME) // HOP + 1
    if n <= 0:
        return np.zeros((0, PITCHES))
    hz = np.fft.rfftfreq(FRAME, 1 / rate)
    use = np.flatnonzero((hz >= LOW_HZ) & (hz <= HIGH_HZ))
    fold = np.zeros((len(use), PITCHES))
    fold[np.arange(len(use)), np.round(12 * np.log2(hz[use] / 440.0)).astype(int) % PITCHES] = 1
    out = np.zeros((n, PITCHES))
    window = np.hanning(FRAME)
    frames = np.lib.stride_tricks.sliding_window_view(x, FRAME)[::HOP]
    for i in range(0, n, 256):
        out[i : i + 256] = np.abs(np.fft.rfft(frames[i : i + 256] * window)[:, use]) ** 2 @ fold
    return out / np.maximum(out.sum(1, keepdims=True), 1e-9)


def fingerprint(frames: np.ndarray) -> np.ndarray:
    """A packed integer for every place at which the widest filter fits."""
    n = len(frames) - SPAN + 1
    if n <= 0:
        return np.zeros(0, np.uint32)
    # pitches wrap around, so the image holds them twice
    image = np.zeros((len(frames) + 1, 2 * PITCHES + 1))
    image[1:, 1:] = np.concatenate([frames, frames], 1).cumsum(0).cumsum(1)
    start = np.arange(n)

    def area(t0: int, t1: int, p0: int, p1: int) -> np.ndarray:
        return image[start + t1, p1] - image[start + t0, p1] - image[start + t1, p0] + image[start + t0, p0]

    out = np.zeros(n, np.uint32)
    for kind, width, pitch, band, i in filters():
        t, p = width // 2, band // 2
        if kind == "time":
            a, b = area(0, t, pitch, pitch + band), area(t, width, pitch, pitch + band)
        elif kind == "pitch":
            a, b = area(0, width, pitch, pitch + p), area(0, width, pitch + p, pitch + 2 * p)
        elif kind == "cross":
            a = area(0, t, pitch, pitch + p) + area(t, width, pitch + p, pitch + 2 * p)
            b = area(0, t, pitch + p, pitch + 2 * p) + area(t, width, pitch, pitch + p)
        else:
            a, b = area(0, width, pitch, pitch + band), area(0, width, pitch, pitch + PITCHES) / (PITCHES / band)
        value = np.log((a + 0.02) / (b + 0.02))
        level = (value > -0.7).astype(np.uint32) + (value > 0) + (value > 0.7)
        out |= (level ^ level >> 1).astype(np.uint32) << np.uint32(2 * i)  # neighbouring levels differ in one bit
    return out


def fingerprints(recordings: DataFrame, key: str, audio: str = "audio") -> DataFrame:
    """(key, print): array of the recording's integers."""

    def run(batches):
        for batch in batches:
            prints = [fingerprint(chroma(*samples(x))).astype(np.int64) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints, pa.list_(pa.int64()))], [key, "print"])

    return recordings.select(key, audio).mapInArrow(run, T.StructType([recordings.schema[key], T.StructField("print", T.ArrayType(T.LongType()))]))


def render(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", rate: int = 8192, note: int = 384) -> DataFrame:
    """(key, audio): vectors as melodies, a note to each component, whose pitch and octave follow its value."""

    def run(batches):
        time = np.arange(note) / rate
        fade = np.minimum(1, np.minimum(np.arange(note), np.arange(note)[::-1]) / 32)
        tones = np.array([fade * (0.6 * np.sin(2 * np.pi * f * time) + 0.3 * np.sin(4 * np.pi * f * time)) for f in 220.0 * 2 ** (np.arange(36) / 12)])
        for whole in batches:
            for at in range(0, whole.num_rows, 64):
                batch, out = whole.slice(at, 64), []
                for v in batch.column(1).to_pylist():
                    if v is None:
                        out.append(None)
                        continue
                    step = np.clip(np.round(18 + 12 * np.nan_to_num(np.array([x or 0.0 for x in v]))), 0, 35).astype(int)
                    sink = io.BytesIO()
                    with wave.open(sink, "wb") as f:
                        f.setparams((1, 2, rate, 0, "NONE", ""))
                        f.writeframes((tones[step].ravel() * 32767).astype("<i2").tobytes())
                    out.append(sink.getvalue())
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], [key, "audio"])

    return vectors.select(key, vector).mapInArrow(run, T.StructType([vectors.schema[key], T.StructField("audio", T.BinaryType())]))


def bit_errors(x: np.ndarray, y: np.ndarray, a: np.ndarray, b: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Bits that differ between x[a[i]:a[i] + n[i]] and y[b[i]:b[i] + n[i]]."""
    out = np.zeros(len(n), np.int64)
    ends = np.cumsum(n)
    start = 0
    while start < len(n):
        done = int(ends[start - 1]) if start else 0
        stop = max(int(np.searchsorted(ends, done + AT_ONCE, "right")), start + 1)
        part = n[start:stop]
        first = np.cumsum(part) - part
        step = np.arange(int(part.sum()))
        differ = np.bitwise_count(x[np.repeat(a[start:stop] - first, part) + step] ^ y[np.repeat(b[start:stop] - first, part) + step])
        out[start:stop] = np.add.reduceat(differ, first, dtype=np.int64)
        start = stop
    return out


def correlated(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """For every offset from 1 - len(x) to len(y) - 1 the sum of x[i] * y[i + offset], of zeros and ones."""
    size = 1 << (len(x) + len(y) - 1).bit_length()
    sums = np.fft.irfft(np.fft.rfft(x[::-1].astype(np.float64), size) * np.fft.rfft(y.astype(np.float64), size), size)
    return np.rint(sums[: len(x) + len(y) - 1]).astype(np.int64)


def _offsets(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Offsets of two prints that have votes, with votes, common frames and wrong bits, by correlations of whole prints."""
    offset = np.arange(1 - len(x), len(y))
    votes = np.zeros(len(offset), np.int64)
    for v in np.intersect1d(x, y):
        i, j = np.flatnonzero(x == v), np.flatnonzero(y == v)
        if len(i) * len(j) <= 4 * len(offset):
            np.add.at(votes, (j[None] - i[:, None]).ravel() + len(x) - 1, 1)
        else:
            votes += correlated(x == v, y == v)
    wrong = np.zeros(len(offset), np.int64)
    for bit in range(32):
        p, q = x >> np.uint32(bit) & np.uint32(1), y >> np.uint32(bit) & np.uint32(1)
        wrong += correlated(p, 1 - q) + correlated(1 - p, q)
    frames = np.minimum(len(x) - np.maximum(-offset, 0), len(y) - np.maximum(offset, 0))
    met = votes > 0
    return offset[met], votes[met], frames[met], wrong[met]


def aligned(ids: np.ndarray, x: np.ndarray, x_at: np.ndarray, to: np.ndarray, y: np.ndarray, y_at: np.ndarray, error: float, same: bool = False):
    """Parts of (id, to, offset, votes, frames, wrong bits): the best offset of each two rows that align, named from the later
    one; row i of x is ids[i] with x[x_at[i]:x_at[i + 1]].  With ``same`` x is y and each two rows are compared once."""
    order = np.argsort(y, kind="stable")
    known = y[order]
    low = np.searchsorted(known, x, "left")
    meets = np.searchsorted(known, x, "right") - low
    total = np.concatenate([[0], np.cumsum(meets)])[x_at]  # places met by the rows before
    y_row = np.repeat(np.arange(len(y_at) - 1), np.diff(y_at))[order]
    span = int(np.diff(x_at).max(initial=0) + np.diff(y_at).max(initial=0))
    start = 0
    while start < len(x_at) - 1:
        stop = max(int(np.searchsorted(total, total[start] + AT_ONCE, "right")) - 1, start + 1)
        if total[stop] - total[start] > AT_ONCE:
            own = x[x_at[start] : x_at[stop]]
            met = np.unique(np.concatenate([y_row[a : a + n] for a, n in set(zip(low[x_at[start] : x_at[stop]].tolist(), meets[x_at[start] : x_at[stop]].tolist()))]))
            told = [(r, *_offsets(own, y[y_at[r] : y_at[r + 1]])) for r in (met[met < start] if same else met).tolist()]
            rows = [(np.full(len(o), start), np.full(len(o), r), o, v, f, w) for r, o, v, f, w in told]
        else:
            i = np.repeat(np.arange(x_at[start], x_at[stop]), meets[x_at[start] : x_at[stop]])
            n = meets[x_at[start] : x_at[stop]]
            slot = np.arange(len(i)) + np.repeat(low[x_at[start] : x_at[stop]] - np.cumsum(n) + n, n)
            own, other = np.searchsorted(x_at, i, "right") - 1, y_row[slot]
            if same:
                keep = other < own
                i, slot, own, other = i[keep], slot[keep], own[keep], other[keep]
            offset = (order[slot] - y_at[other]) - (i - x_at[own])
            key, votes = np.unique((own * len(y_at) + other) * 2 * span + offset + span, return_counts=True)
            own, other, offset = key // (2 * span) // len(y_at), key // (2 * span) % len(y_at), key % (2 * span) - span
            begin, other_begin = np.maximum(-offset, 0), np.maximum(offset, 0)
            frames = np.minimum(np.diff(x_at)[own] - begin, np.diff(y_at)[other] - other_begin)
            keep = frames >= LEAST_FRAMES
            own, other, offset, votes, frames = own[keep], other[keep], offset[keep], votes[keep], frames[keep]
            rows = [(own, other, offset, votes, frames, bit_errors(x, y, x_at[own] + begin[keep], y_at[other] + other_begin[keep], frames))]
        start = stop
        for part in rows:
            few = (part[4] >= LEAST_FRAMES) & (part[5] <= error * 32 * part[4])
            own, other, offset, votes, frames, wrong = (c[few] for c in part)
            p, q = ids[own], to[other]
            later, earlier, offset = np.maximum(p, q), np.minimum(p, q), np.where(p > q, offset, -offset)
            by = np.lexsort((offset, np.abs(offset), -votes, earlier, later))
            best = [c[by] for c in (later, earlier, offset, votes, frames, wrong)]
            first = np.ones(len(by), bool)
            first[1:] = (best[0][1:] != best[0][:-1]) | (best[1][1:] != best[1][:-1])
            yield [c[first] for c in best]


def packed(classes: DataFrame, blocks: int) -> DataFrame:
    """(block, ids, sizes, ints): the prints of classes (id, print, block), packed by block."""

    def run(batches):
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []

        def out():
            ids, sizes, block, ints = (np.concatenate(x) for x in zip(*held))
            held.clear()
            of = np.repeat(block, sizes)
            for b in np.unique(block):
                yield b, ids[block == b].tobytes(), sizes[block == b].tobytes(), ints[of == b].tobytes()

        def sent():
            rows = list(out())
            return pa.RecordBatch.from_arrays([pa.array([int(r[0]) for r in rows], pa.int64()), *(pa.array([r[i] for r in rows], pa.binary()) for i in (1, 2, 3))], ["block", "ids", "sizes", "ints"])

        count = 0
        for batch in batches:
            prints = batch.column(1)
            ints = prints.flatten().to_numpy(zero_copy_only=False).astype("<u4")
            held.append((batch.column(0).to_numpy().astype("<i8"), pc.list_value_length(prints).to_numpy().astype("<i8"), batch.column(2).to_numpy(), ints))
            count += len(ints)
            if count > AT_ONCE:
                yield sent()
                count = 0
        if held:
            yield sent()

    own = F.pmod(F.xxhash64("id"), F.lit(blocks).cast("long"))
    return classes.select("id", "print", own.alias("block")).mapInArrow(run, "block long, ids binary, sizes binary, ints binary")


def met(classes: DataFrame, error: float, told, schema: str) -> DataFrame:
    """What ``told`` makes of the links between every two blocks of classes (id, print): of the ids and of the parts of links."""
    size = classes.agg(F.sum(F.size("print"))).first()[0] or 0
    blocks = max(BLOCKS, -(-size // BLOCK_FRAMES))
    # every block goes to the tasks of all blocks
    other = F.explode(F.expr(f"sequence(0L, {blocks - 1}L)"))
    each = packed(classes, blocks).select("*", other.alias("other")).select(F.least("block", "other").alias("a"), F.greatest("block", "other").alias("b"), "block", "ids", "sizes", "ints")

    def run(table: pa.Table) -> pa.Table:
        a, b = table.column(0)[0].as_py(), table.column(1)[0].as_py()

        def side(block: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            rows = table.filter(pc.equal(table.column(2), block))
            ids, sizes, ints = (np.concatenate([np.zeros(0, kind), *(np.frombuffer(x, kind) for x in rows.column(i).to_pylist())]) for i, kind in ((3, "<i8"), (4, "<i8"), (5, "<u4")))
            return ids, ints, np.concatenate([[0], np.cumsum(sizes)])

        ids, x, x_at = side(a)
        to, y, y_at = (ids, x, x_at) if a == b else side(b)
        return told(np.unique(np.concatenate([ids, to])), aligned(ids, x, x_at, to, y, y_at, error, a == b))

    return each.groupBy("a", "b").applyInArrow(run, schema)


_NO_LINKS = [np.zeros(0, np.int64)] * 6


def links(classes: DataFrame, error: float = MOST_ERROR) -> DataFrame:
    """(id, to, offset, votes, frames, bit_error): all classes (id, print) and the earlier ones that they align with."""

    def told(_ids, parts) -> pa.Table:
        later, earlier, offset, votes, frames, wrong = (np.concatenate(c) for c in zip(_NO_LINKS, *parts))
        made = [later, earlier, offset.astype(np.int32), votes, frames.astype(np.int32), wrong / (32.0 * frames)]
        return pa.table([pa.array(c) for c in made], names=["id", "to", "offset", "votes", "frames", "bit_error"])

    return met(classes, error, told, "id long, to long, offset int, votes long, frames int, bit_error double")


def linked(classes: DataFrame, error: float = MOST_ERROR) -> DataFrame:
    """(id, n, least, to, offset, votes, frames, bit_error) of classes with links, by task: how many it has, the least class that
    these lead to, and the earlier one with the fewest wrong bits (then the least), if any.  Links themselves aren't sent."""

    def told(ids, parts) -> pa.Table:
        n, label = np.zeros(len(ids), np.int64), np.arange(len(ids))
        best = [*_NO_LINKS, np.zeros(0)]
        for part in parts:
            own, other = np.searchsorted(ids, part[0]), np.searchsorted(ids, part[1])
            n += np.bincount(own, minlength=len(ids)) + np.bincount(other, minlength=len(ids))
            join(label, own, other)
            best = [np.concatenate(c) for c in zip(best, [*part, part[5] / (32.0 * part[4])])]
            by = np.lexsort((best[1], best[6], best[0]))
            first = np.ones(len(by), bool)
            first[1:] = best[0][by][1:] != best[0][by][:-1]
            best = [c[by[first]] for c in best]
        row = np.flatnonzero(n)
        at = np.searchsorted(best[0], ids[row])
        none = np.append(best[0], -1)[at] != ids[row] if len(best[0]) else np.ones(len(row), bool)
        shown = [pa.array(np.append(c, 0)[at], kind, mask=none) for c, kind in zip(best[1:5] + best[6:], (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.float64()))]
        return pa.table([pa.array(ids[row]), pa.array(n[row]), pa.array(ids[label[row]]), *shown], names=["id", "n", "least", "to", "offset", "votes", "frames", "bit_error"])

    return met(classes, error, told, "id long, n long, least long, to long, offset int, votes long, frames int, bit_error double")


def join(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Lead ``label``, in which each place names a smaller one of its group or itself, to the least place that links (a, b) reach."""
    while True:
        x, y = label[a], label[b]
        if np.array_equal(x, y):
            return
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(label[label], label):
            label[:] = label[label]


def align(prints: DataFrame, key: str, error: float = MOST_ERROR) -> DataFrame:
    """(key, n_ints, print_sha256, class_id, copies, group_id, n_links, aligned_with, offset, votes, frames, bit_error) of every row:
    the least key with an equal fingerprint and how many have it; the least key that alignments lead to; how many were found
    for its class; and of these the one with the fewest wrong bits (then the least key) that is earlier, with its figures."""
    prints = staged(prints.select(F.col(key).cast("long").alias("k"), "print").withColumn("sha", F.sha2(F.array_join(F.col("print").cast("array<string>"), ","), 256)))
    classes = staged(prints.where((F.size("print") > 0) & F.col("k").isNotNull()).groupBy("sha").agg(F.min("k").alias("id"), F.count("*").alias("copies"), F.any_value("print").alias("print")))
    found = staged(linked(classes, error))
    groups = components(found.select(F.col("id").alias("x"), F.col("least").alias("y")))
    per = found.groupBy("id").agg(F.sum("n").alias("n_links"), F.min(F.when(F.col("to").isNotNull(), F.struct("bit_error", "to", "offset", "votes", "frames"))).alias("f"))
    told = classes.select("id", "sha", "copies").join(groups, "id", "left").join(per, "id", "left")
    told = told.select("sha", "id", "copies", F.coalesce("component", "id").alias("group_id"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), "f")
    joined = prints.join(told, (prints["sha"] == told["sha"]) & prints["k"].isNotNull(), "left")
    long = lambda c: F.col(f"f.{c}").cast("long").alias(c)
    return joined.select(
        F.col("k").alias(key), F.size("print").cast("long").alias("n_ints"), prints["sha"].alias("print_sha256"), F.coalesce("id", "k").alias("class_id"), F.coalesce("copies", F.lit(1).cast("long")).alias("copies"), F.coalesce("group_id", "k").alias("group_id"),
        F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.col("f.to").alias("aligned_with"), long("offset"), long("votes"), long("frames"), F.col("f.bit_error").alias("bit_error"),
    )
