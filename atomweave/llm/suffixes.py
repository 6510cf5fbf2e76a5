"""Bytes covered by a string of LENGTH bytes that starts anywhere else too, by distributed difference-cover suffix sorting.

1. Equal texts are one, counted.  In the others anchors are chosen: of each run of WINDOW places the one whose next GRAM
   bytes hash lowest (the first of equal ones), so that equal strings have equal anchors, at most WINDOW apart.  A string
   of LENGTH bytes holds the first anchor at or after its start with at least SURE bytes from there on; anchors whose SURE
   bytes occur once are out.  What surrounds the others are the stretches that are sorted; equal stretches are one.
2. The suffixes at anchors are sorted by difference cover.  A suffix is the chain of its anchors; a symbol is the SYMBOL
   bytes at an anchor, which tell where the next one is, numbered in the order of bytes, so that chains sort as bytes do.
   Anchors whose distance from the end of the chain isn't divisible by 3 are the sample: their triples of symbols are
   sorted and named.  While equal names tell less than LENGTH bytes, the names are sorted the same way, three steps being
   one.  The remaining third is merged by counting: a remaining suffix is compared with either kind of sampled ones by one
   or two symbols and the rank of what follows, so its rank is a sum of counts.
3. All other suffixes are merged by the bytes up to their anchor and the rank of that.  In the order of ranks the prefixes
   of neighbours are compared; suffixes whose bytes before the anchor agree and whose anchors lie in one run of neighbours
   that share the rest of LENGTH bytes are equal.  Runs that reach over the border of a task are settled by a second look
   at their fingerprints.

Names, ranks and counts are dense numbers made by sorting ranges and adding up the counts of earlier ranges, so no order
passes one task.  Texts, stretches and symbols are told apart by 64-bit fingerprints.

Defined results: a null text is empty, texts shorter than LENGTH lose nothing, texts of any length are taken whole, equal
texts of LENGTH bytes or more lose everything whatever their keys, and rows that repeat a key or have none are judged like
all others.  An empty table gives no rows.  What is left may end within a character, so it's returned as bytes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from atomweave.llm.common import BROADCAST_ROWS, collected, discard, slices, small_batches, staged, utf8
from atomweave.llm.words import mix

LENGTH, WINDOW, GRAM = 200, 64, 8
SURE, SYMBOL = LENGTH - WINDOW + 1, WINDOW + GRAM
#: Anchors of a packet, which a task combines, and of a fragment of the fingerprints, which a task groups.
PACKET, FRAGMENT = 300_000, 250_000
#: Places that are numbered at once when anchors are chosen.
PLACES = 1 << 24
#: Powers that a worker keeps from call to call, and anchors whose bytes are compared at once, or at most if they share a run.
KEPT, JUDGED, LONG_RUN = 1 << 21, 6_000, 100_000

U64 = np.uint64
_BYTE = mix(np.arange(11, 267, dtype=U64) * U64(0x9E3779B97F4A7C15))
_ODD = 0xD1B54A32D192ED03
_power: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2 ** 64; up to KEPT of them are kept for the next call."""
    if len(_power.get("up", ())) >= n:
        return _power["up"], _power["down"]
    made = {}
    for name, base in (("up", _ODD), ("down", pow(_ODD, -1, 1 << 64))):
        x = np.full(1 << (n - 1).bit_length(), base, U64)
        x[0] = 1
        made[name] = np.multiply.accumulate(x, out=x)
    if n <= KEPT:
        _power.update(made)
    return made["up"], made["down"]


class Prints:
    """Fingerprints of any stretches of some bytes."""

    def __init__(self, data: np.ndarray):
        up, self.down = _powers(len(data) + 1)
        self.sums = np.empty(len(data) + 1, U64)
        self.sums[0] = 0
        np.take(_BYTE, data, out=self.sums[1:], mode="clip")
        self.sums[1:] *= up[: len(data)]
        np.cumsum(self.sums[1:], out=self.sums[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * self.down[starts] + (ends - starts).astype(U64))


def chosen(data: np.ndarray) -> np.ndarray:
    """For each place whose next SYMBOL bytes are there, the anchor at or after it: the least gram of WINDOW, the first of equal ones."""
    n = len(data) - SYMBOL + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    out = np.empty(n, np.int64)
    for at in range(0, n, PLACES - WINDOW):
        part = np.ascontiguousarray(data[at : min(at + PLACES - 1, len(data))])
        grams = len(part) - GRAM + 1
        low = np.ndarray(grams, "<u8", part, 0, (1,)) * U64(0x9E3779B97F4A7C15)  # the eight bytes from each place on
        low ^= low >> U64(29)
        low *= U64(0xBF58476D1CE4E5B9)
        low &= ~U64(PLACES - 1)
        low |= np.arange(grams, dtype=U64)
        done = 1
        while 2 * done <= WINDOW:
            low = np.minimum(low[:-done], low[done:])
            done *= 2
        end = min(len(low), PLACES - WINDOW, n - at)
        out[at : at + end] = (low[:end] & U64(PLACES - 1)).astype(np.int64) + at
    return out


def _anchors(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and place of the anchors of all strings of LENGTH bytes within rows."""
    first = chosen(data)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[: len(first)]
    fits = np.arange(len(first)) + LENGTH <= offsets[1:][row]
    places = first[fits]
    if len(places):
        places = places[np.concatenate([[True], places[1:] != places[:-1]])]
        places = np.unique(places)
    return np.searchsorted(offsets, places, "right") - 1, places


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary column and the offsets of its values."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


_PACKED = [("key", "<u8"), ("id", "<i8"), ("at", "<i4")]


def _pack(rows: dict[str, np.ndarray]) -> bytes:
    return b"".join(np.ascontiguousarray(rows[c].astype(kind)).tobytes() for c, kind in _PACKED)


def _unpack(blobs: list[bytes]) -> dict[str, np.ndarray]:
    parts: dict[str, list[np.ndarray]] = {c: [] for c, _ in _PACKED}
    for blob in blobs:
        n, at = len(blob) // 20, 0
        for c, kind in _PACKED:
            parts[c].append(np.frombuffer(blob, kind, n, at))
            at += n * np.dtype(kind).itemsize
    return {c: np.concatenate(x) for c, x in parts.items()}


def _shared(rows: dict[str, np.ndarray]) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]:
    """Rows in order without repeated ones, whether each is the first of its key, and whether its key has others."""
    order = np.lexsort((rows["at"], rows["id"], rows["key"]))
    rows = {c: x[order] for c, x in rows.items()}
    fresh = np.ones(len(order), bool)
    fresh[1:] = np.any([rows[c][1:] != rows[c][:-1] for c in rows], axis=0)
    rows = {c: x[fresh] for c, x in rows.items()}
    head = np.ones(len(rows["key"]), bool)
    head[1:] = rows["key"][1:] != rows["key"][:-1]
    group = np.cumsum(head) - 1
    return rows, head, np.bincount(group)[group] > 1


def _pooled(size: int):
    fragments = max(16, size // (WINDOW // 2) // FRAGMENT)

    def run(batches):
        """Anchors by fragment of their fingerprints; those of one packet that share theirs are known at once."""
        held: list[dict[str, np.ndarray]] = []

        def packed():
            rows, head, many = _shared({c: np.concatenate([x[c] for x in held]) for c, _ in _PACKED})
            held.clear()
            first = {c: x[head] for c, x in rows.items()}
            part = ((first["key"] >> U64(32)) * U64(fragments) >> U64(32)).astype(np.int64)
            cut = np.flatnonzero(np.diff(part, prepend=-1))
            out = [(int(part[a]), _pack({c: x[a:b] for c, x in first.items()})) for a, b in zip(cut.tolist(), [*cut[1:].tolist(), len(part)])]
            rest = {c: x[many] for c, x in rows.items()}
            for a in range(0, len(rest["key"]), 50_000):
                some = {c: x[a : a + 50_000] for c, x in rest.items()}
                out.append((-1 - int(some["id"].sum() % fragments), _pack(some)))
            return pa.RecordBatch.from_arrays([pa.array([f for f, _ in out], pa.int64()), pa.array([x for _, x in out], pa.binary())], ["fragment", "rows"])

        count = 0
        for whole in batches:
            for batch in slices(whole, "t", 1 << 19):
                data, offsets = utf8(batch.column(1))
                row, places = _anchors(data, offsets)
                ids = batch.column(0).to_numpy(zero_copy_only=False)
                held.append({"key": Prints(data).of(places, places + SURE), "id": ids[row], "at": (places - offsets[row]).astype(np.int32)})
                count += len(row)
                if count > PACKET:
                    yield packed()
                    count = 0
        if count:
            yield packed()

    def reduce(table: pa.Table) -> pa.Table:
        rows = _unpack(table.column(1).to_pylist())
        if table.column(0)[0].as_py() >= 0:
            rows, _, many = _shared(rows)
            rows = {c: x[many] for c, x in rows.items()}
        return pa.table({"id": pa.array(rows["id"]), "at": pa.array(rows["at"])})

    return run, reduce


def stretches(texts: DataFrame) -> DataFrame:
    """(id, start, g, bytes): what may repeat of the texts (id, t), and the fingerprint of each stretch."""
    size = texts.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    run, reduce = _pooled(size)
    shared = texts.mapInArrow(run, "fragment long, rows binary").groupBy("fragment").applyInArrow(reduce, "id long, at int")
    shared = staged(shared.groupBy("id").agg(F.sort_array(F.collect_set("at")).alias("ats")))

    def once(batches):
        seen: set[int] = set()
        for batch in batches:
            ids = batch.column(0).to_pylist()
            keep = [i for i, x in enumerate(ids) if x not in seen and not seen.add(x)]
            yield batch.take(pa.array(keep, pa.int64()))

    few = shared.count() <= BROADCAST_ROWS
    wanted = texts.join(F.broadcast(shared.select("id")) if few else shared.select("id"), "id", "left_semi").select("id", "t").mapInArrow(once, "id long, t string")

    def cut(batches):
        for whole in batches:
            for batch in slices(whole, "t", 1 << 19):
                data, offsets = utf8(batch.column(1))
                ids, starts, pieces = [], [], []
                for i, (name, ats) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist())):
                    size = int(offsets[i + 1] - offsets[i])
                    at = np.array(ats, np.int64)
                    low, high = np.maximum(at - WINDOW + 1, 0), np.minimum(at + LENGTH, size)
                    edge = np.flatnonzero(np.concatenate([[True], low[1:] >= high[:-1]]))
                    for a, b in zip(low[edge].tolist(), high[np.concatenate([edge[1:] - 1, [len(at) - 1]])].tolist()):
                        ids.append(name)
                        starts.append(a)
                        pieces.append(data[offsets[i] + a : offsets[i] + b].tobytes())
                if ids:
                    flat, at = _flat(pa.array(pieces, pa.large_binary()))
                    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(starts, pa.int32()), pa.array(Prints(flat).of(at[:-1], at[1:]).view(np.int64)), pa.array(pieces, pa.binary())], ["id", "start", "g", "bytes"])

    both = wanted.join(shared, "id").select("id", "t", "ats").mapInArrow(cut, "id long, start int, g long, bytes binary")
    out = staged(both.dropDuplicates(["id", "start"]))
    discard(shared)
    collected(texts.sparkSession)
    return out


# ---- suffix sorting ---------------------------------------------------------------------------------------------
# Stretches are held in parcels, one row each, of about NODES anchors.  What must be put in order are keys of bytes: every
# parcel sends the distinct ones it has, with counts, to the range in which they lie; a range sorts what it gets and tells
# each key what the counts of all smaller ones add up to.

#: Anchors of a parcel, and keys that are looked at, at most, to find even ranges.
NODES, SAMPLE = 20_000, 100_000
#: A symbol or triple that tells all bytes up to the end.
ALL = 1 << 30

#: A parcel's stretches (fingerprints, numbers of anchors) and their chains of anchors: places, symbols, number of the next
#: anchor in the parcel (-1: none), distance from the end modulo 3, how many bytes from its place a symbol tells.
_CHAIN = {"g": "<i8", "size": "<i4", "at": "<i4", "symbol": "<i8", "next": "<i4", "kind": "<i1", "reach": "<i4"}
CHAINS = "p int, " + ", ".join(f"{c} binary" for c in _CHAIN) + ", rests long, ones long"


class Pieces:
    """Stretches one after another: their anchors, the number of the one after each (-1: none), and rows."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets = data, offsets
        self.first = chosen(self.data)
        row = np.repeat(np.arange(len(self.offsets) - 1), np.diff(self.offsets))
        self.left = self.offsets[1:][row] - np.arange(len(row))  # bytes from a place to the end of its stretch
        here = self.left[: len(self.first)]
        self.at = np.unique(self.first[here >= SYMBOL])
        self.row = row[self.at]
        self.begin = np.searchsorted(self.row, np.arange(len(self.offsets)))  # the first anchor of each row
        inner = self.left[self.at] > SYMBOL
        self.following = np.full(len(self.at), -1)
        self.following[inner] = np.searchsorted(self.at, self.first[self.at[inner] + 1])

    def number(self, k: np.ndarray) -> np.ndarray:
        """Numbers of anchors within their rows."""
        return k - self.begin[self.row[k]]

    def around(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """How far back (bit d) strings of LENGTH bytes begin whose first anchor is each, and what bytes these reach over."""
        i = np.flatnonzero(self.left[: len(self.first)] >= LENGTH)
        mask = np.zeros(len(self.at), U64)
        if len(i):
            slot = np.searchsorted(self.at, self.first[i])
            head = np.flatnonzero(np.diff(slot, prepend=-1))
            mask[slot[head]] = np.bitwise_or.reduceat(U64(1) << (self.first[i] - i).astype(U64), head)
        return mask, np.maximum(self.at - SIDE, self.offsets[self.row]), self.at + np.minimum(self.left[self.at], LENGTH)

    def symbols(self) -> np.ndarray:
        """The SYMBOL bytes at each anchor, and how many there are, as keys in the order of bytes."""
        padded = np.concatenate([self.data, np.zeros(SYMBOL, np.uint8)])
        size = np.minimum(self.left[self.at], SYMBOL)
        out = np.empty((len(self.at), SYMBOL + 1), np.uint8)
        out[:, :SYMBOL] = np.where(np.arange(SYMBOL)[None] < size[:, None], padded[self.at[:, None] + np.arange(SYMBOL)[None]], 0)
        out[:, SYMBOL] = size
        return out.view(f"S{SYMBOL + 1}").ravel()


def _parcel(table: pa.Table) -> pa.Table:
    """The stretches (p, g, bytes) of a parcel as one row."""
    order = np.argsort(table.column("g").to_numpy(), kind="stable")
    table = table.take(pa.array(order))
    flat, at = _flat(table.column("bytes"))
    return pa.table({"p": table.column("p").slice(0, 1), "g": pa.array([table.column("g").to_numpy().astype("<i8").tobytes()], pa.binary()), "length": pa.array([np.diff(at).astype("<i4").tobytes()], pa.binary()), "bytes": pa.array([flat.tobytes()], pa.binary())})


class Parcel:
    """One row of a batch, whose columns are looked up when they're asked for: lists of numbers as arrays by field."""

    def __init__(self, batch: pa.RecordBatch, i: int):
        self.batch, self.i = batch, i

    def __contains__(self, name: str) -> bool:
        return name in self.batch.schema.names

    def __getitem__(self, name: str):
        return self.batch.column(self.batch.schema.get_field_index(name))[self.i].as_py()

    def fields(self, name: str, *wanted: str) -> list[np.ndarray]:
        rows = self.batch.column(self.batch.schema.get_field_index(name)).slice(self.i, 1).flatten()
        return [rows.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in wanted]


def _rows(batches):
    for batch in batches:
        for i in range(batch.num_rows):
            yield Parcel(batch, i)


def _opened(row: Parcel) -> tuple[np.ndarray, Pieces]:
    size = np.frombuffer(row["length"], "<i4").astype(np.int64)
    return np.frombuffer(row["g"], "<i8"), Pieces(np.frombuffer(row["bytes"], np.uint8), np.concatenate([[0], np.cumsum(size)]))


class Chains:
    """The chains of a parcel."""

    def __init__(self, row: dict):
        for c, kind in _CHAIN.items():
            x = np.frombuffer(row[c], kind)
            setattr(self, c, x if c == "kind" else x.astype(np.int64))
        if "ranks" in row:
            self.ranks = np.frombuffer(row["ranks"], "<i8")

    def ahead(self, k: np.ndarray) -> np.ndarray:
        return np.where(k >= 0, self.next[k], -1) if len(self.next) else k

    def triples(self) -> tuple[np.ndarray, ...]:
        """The sampled anchors, the numbers of the next two, and how many bytes their triples tell."""
        k = np.flatnonzero(self.kind != 0)
        one = self.next[k]
        two = self.ahead(one)
        told = np.where(two >= 0, _after(self.at, two, 0) - self.at[k] + _after(self.reach, two, 0), ALL)
        return k, one, two, np.minimum(told, ALL)


def _after(x: np.ndarray, where: np.ndarray, missing: int) -> np.ndarray:
    return np.where(where >= 0, x[where], missing) if len(x) else where


def _kinds(following: np.ndarray) -> np.ndarray:
    """Distances from the ends of chains modulo 3."""
    out, ahead = [0] * len(following), following.tolist()
    for i in range(len(ahead) - 1, -1, -1):
        out[i] = (out[ahead[i]] + 1) % 3 if ahead[i] >= 0 else 1
    return np.array(out, np.int64)


def _chain_row(p: int, **arrays) -> pa.RecordBatch:
    kind = arrays["kind"]
    made = [pa.array([p], pa.int32())] + [pa.array([arrays[c].astype(dtype).tobytes()], pa.binary()) for c, dtype in _CHAIN.items()]
    made += [pa.array([int((kind == k).sum())], pa.int64()) for k in (0, 1)]
    return pa.RecordBatch.from_arrays(made, ["p", *_CHAIN, "rests", "ones"])


def _key(*columns: np.ndarray) -> np.ndarray:
    """Keys of whole numbers in the order of bytes."""
    return np.stack(columns, 1).astype(">u8").view(f"S{8 * len(columns)}").ravel()


def _distinct(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys in order, sums of their counts, and where each key went."""
    own, where = np.unique(keys, return_inverse=True)
    return own, np.stack([np.bincount(where, counts[:, j], len(own)).astype(np.int64) for j in range(counts.shape[1])], 1), where


def _asked(state: DataFrame, ask, width: int, counts: int) -> tuple[DataFrame, np.ndarray, int]:
    """What parcels are told about their keys (p, told), what ranges begin with, and the number of keys that are open: with a
    count over 1 in the first column and any in the second.  ``ask`` gives a parcel's keys and counts."""
    parcels = state.count()
    each = max(16, min(SAMPLE // 128, parcels))

    def look(batches):
        for row in _rows(batches):
            keys, _ = ask(row)
            step = max(1, len(keys) // each)
            yield pa.RecordBatch.from_arrays([pa.array([k.ljust(width, b"\0") for k in np.unique(keys)[::step][:each].tolist()], pa.binary())], ["key"])

    few = state.where(F.pmod(F.xxhash64("p"), F.lit(max(1, parcels // 64))) == 0)  # for even ranges some parcels will do
    some = sorted(bytes(r["key"]) for r in few.mapInArrow(look, "key binary").limit(SAMPLE).collect()) if parcels > 1 else []
    borders = np.array(some[:: max(1, len(some) // max(1, parcels))][1:], f"S{width}")

    def send(batches):
        for row in _rows(batches):
            own, sums, _ = _distinct(*ask(row))
            ranges = np.searchsorted(borders, own, "right")
            head = np.flatnonzero(np.diff(ranges, prepend=-1))
            cut = [*head.tolist(), len(own)]
            made = [(int(ranges[a]), row["p"], own[a:b].tobytes(), sums[a:b].astype("<i8").tobytes()) for a, b in zip(cut, cut[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*made) if made else [()] * 4, (pa.int32(), pa.int32(), pa.binary(), pa.binary()))], ["r", "p", "keys", "counts"])

    def answer(table: pa.Table) -> pa.Table:
        keys = [np.frombuffer(x, f"S{width}") for x in table.column("keys").to_pylist()]
        sums = np.concatenate([np.frombuffer(x, "<i8").reshape(-1, counts) for x in table.column("counts").to_pylist()])
        _, total, where = _distinct(np.concatenate(keys), sums)
        before = (np.cumsum(total, 0) - total)[where]
        cut = np.concatenate([[0], np.cumsum([len(k) for k in keys])])
        open_ = int(((total[:, 0] > 1) & (total[:, -1] > 0)).sum())
        whole = total.sum(0).astype("<i8").tobytes()
        n = table.num_rows
        return pa.table({"p": table.column("p"), "r": table.column("r"), "before": pa.array([before[a:b].astype("<i8").tobytes() for a, b in zip(cut, cut[1:])], pa.binary()), "total": pa.array([whole] * n, pa.binary()), "open": pa.array([open_] * n, pa.int64())})

    replies = staged(state.mapInArrow(send, "r int, p int, keys binary, counts binary").groupBy("r").applyInArrow(answer, "p int, r int, before binary, total binary, open long"))
    totals = {r["r"]: r for r in replies.groupBy("r").agg(F.first("total").alias("total"), F.first("open").alias("open")).collect()}
    begins = np.zeros((len(borders) + 2, counts), np.int64)
    for r, row in totals.items():
        begins[r + 1] = np.frombuffer(row["total"], "<i8")
    return replies.groupBy("p").agg(F.collect_list(F.struct("r", "before")).alias("told")), np.cumsum(begins, 0), sum(r["open"] for r in totals.values())


def _before(row: Parcel, begins: np.ndarray, ask) -> np.ndarray:
    """For each key of a parcel the counts of all smaller ones."""
    told = [np.frombuffer(x["before"], "<i8").reshape(-1, begins.shape[1]) + begins[x["r"]] for x in sorted(row["told"], key=lambda x: x["r"])]
    _, where = np.unique(ask(row)[0], return_inverse=True)
    return np.concatenate(told)[where] if told else np.zeros((0, begins.shape[1]), np.int64)


def _joined(state: DataFrame, more: DataFrame) -> DataFrame:
    return state.join(more, "p", "left").withColumn("told", F.coalesce("told", F.array().cast("array<struct<r: int, before: binary>>")))


def _ask_symbols(row: Parcel):
    keys = _opened(row)[1].symbols()
    return keys, np.ones((len(keys), 1), np.int64)


def _ask_triples(row: Parcel):
    c = Chains(row)
    k, one, two, told = c.triples()
    return _key(c.symbol[k], _after(c.symbol, one, 0), _after(c.symbol, two, 0)), np.stack([np.ones(len(k), np.int64), (told < LENGTH).astype(np.int64)], 1)


def _sides(c: Chains):
    """(anchors, side) and keys by which a remaining suffix is compared with either kind of sampled ones: with those of kind 2
    by a symbol and the rank after it, with those of kind 1 by two symbols and the rank after them."""
    rank = np.zeros(len(c.kind), np.int64)
    rank[c.kind != 0] = c.ranks
    for side in (1, 2):
        k = np.flatnonzero((c.kind == 0) | (c.kind == side))
        one = c.next[k]
        b, r = (np.zeros(len(k), np.int64), _after(rank, one, 0)) if side == 2 else (_after(c.symbol, one, 0), _after(rank, c.ahead(one), 0))
        yield k, side, _key(np.full(len(k), side), c.symbol[k], b, r)


def _ask_sides(row: Parcel):
    c = Chains(row)
    k, _, keys = zip(*_sides(c))
    rest = (c.kind[np.concatenate(k)] == 0).astype(np.int64)
    return np.concatenate(keys), np.stack([rest, 1 - rest], 1)


def _ranks(p: int, ranks: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([ranks.astype("<i8").tobytes()], pa.binary())], ["p", "ranks"])


def ranks(chains: DataFrame) -> DataFrame:
    """(p, ranks) of the chains' suffixes: 1 and the number of smaller ones; of suffixes that share their first LENGTH bytes,
    either may count as smaller or none."""
    told, begins, open_ = _asked(chains, _ask_triples, 24, 2)
    named = _joined(chains, told)

    def names(batches):
        for row in _rows(batches):
            yield _ranks(row["p"], _before(row, begins, _ask_triples)[:, 0] + 1)

    def reduced(batches):
        """The sampled anchors alone, three steps being one, with names as symbols."""
        for row in _rows(batches):
            c = Chains(row)
            k, _, two, reach = c.triples()
            three = c.ahead(two)
            ahead = np.where(three >= 0, np.searchsorted(k, three), -1)
            size = np.diff(np.searchsorted(k, np.concatenate([[0], np.cumsum(c.size)])))
            yield _chain_row(row["p"], g=c.g, size=size, at=c.at[k], symbol=_before(row, begins, _ask_triples)[:, 0] + 1, next=ahead, kind=_kinds(ahead), reach=reach)

    # equal names that tell less than LENGTH bytes are told apart by sorting the names
    sampled = ranks(staged(named.mapInArrow(reduced, CHAINS))) if open_ else named.mapInArrow(names, "p int, ranks binary")
    state = staged(chains.join(sampled, "p"))
    sums = state.agg(F.sum("rests").alias("rests"), F.sum("ones").alias("ones")).first()
    side_two = np.array([sums["rests"] or 0, sums["ones"] or 0])  # the counts of side 1, which all come before side 2
    told, starts, _ = _asked(state, _ask_sides, 32, 2)

    def merged(batches):
        for row in _rows(batches):
            c = Chains(row)
            before = _before(row, starts, _ask_sides)
            rank, done = np.ones(len(c.kind), np.int64), 0
            rank[c.kind != 0] = c.ranks
            for k, side, keys in _sides(c):
                rests, kinds = (before[done : done + len(keys)] - (side_two if side == 2 else 0)).T
                done += len(keys)
                rest = c.kind[k] == 0
                rank[k] += np.where(rest, kinds + (rests if side == 2 else 0), rests)
            yield _ranks(row["p"], rank)

    return _joined(state, told).mapInArrow(merged, "p int, ranks binary")


def _parcel_of(pieces: DataFrame) -> Column:
    """The parcel of each stretch (g, bytes)."""
    size = pieces.agg(F.sum(F.octet_length("bytes"))).first()[0] or 0
    return F.pmod(F.xxhash64("g"), F.lit(max(1, size // (WINDOW // 2) // NODES))).cast("int")


def sorted_suffixes(pieces: DataFrame) -> DataFrame:
    """Parcels (p, g, length, bytes, ranks) of the stretches (g, bytes), with the rank of the suffix at each anchor."""
    held = staged(pieces.withColumn("p", _parcel_of(pieces)).groupBy("p").applyInArrow(_parcel, "p int, g binary, length binary, bytes binary"))
    told, begins, _ = _asked(held, _ask_symbols, SYMBOL + 1, 1)

    def chained(batches):
        for row in _rows(batches):
            g, p = _opened(row)
            symbol = _before(row, begins, _ask_symbols)[:, 0] + 1
            yield _chain_row(row["p"], g=g, size=np.diff(p.begin), at=p.at - p.offsets[p.row], symbol=symbol, next=p.following, kind=_kinds(p.following), reach=np.where(p.following >= 0, SYMBOL, ALL))

    return staged(held.join(ranks(staged(_joined(held, told).mapInArrow(chained, CHAINS))), "p"))


# ---- all suffixes -----------------------------------------------------------------------------------------------

#: Bytes before an anchor and after its SURE bytes that a string of LENGTH bytes around it can have.
SIDE = WINDOW - 1


def _taken(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Stretches of bytes as a binary column."""
    size = ends - starts
    offsets = np.concatenate([[0], np.cumsum(size)])
    taken = data[np.repeat(starts - offsets[:-1], size) + np.arange(offsets[-1])]
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(taken))]).cast(pa.binary())


def _places(g: np.ndarray, p: Pieces) -> tuple[np.ndarray, ...]:
    """Of the anchors that some string of LENGTH bytes has first: numbers, fingerprints of all that these reach over, bits and
    the range of bytes."""
    mask, low, high = p.around()
    k = np.flatnonzero(mask)
    v = mix(Prints(p.data).of(low[k], high[k]) ^ (p.at - low)[k].astype(U64) * U64(_ODD))
    return k, v.view(np.int64), mask[k], low[k], high[k]


def _placed(batches):
    """(v, p, k, n): where places with equal bytes all around are, each once in a parcel, and how often they're there."""
    for row in _rows(batches):
        g, p = _opened(row)
        k, v, *_ = _places(g, p)
        own, times = row.fields("t", "g", "n")  # the parcel's stretches are in the order of g
        n = times[np.argsort(own, kind="stable")][p.row[k]]
        own, first, where = np.unique(v, return_index=True, return_inverse=True)
        total = np.bincount(where, n, len(own)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(np.full(len(own), row["p"], np.int32)), pa.array(k[first].astype(np.int32)), pa.array(total)], ["v", "p", "k", "n"])


def _contexts(batches):
    """(v, rank, n, mask, left, around) of the anchors (v, k, n) that parcels are asked for."""
    for row in _rows(batches):
        g, p = _opened(row)
        mask, low, high = p.around()
        v, k, n = row.fields("asked", "v", "k", "n")
        numbers = [v, np.frombuffer(row["ranks"], "<i8")[k], n, mask[k].view(np.int64), (p.at - low)[k]]
        yield pa.RecordBatch.from_arrays([*map(pa.array, numbers), _taken(p.data, low[k], high[k])], ["v", "rank", "n", "mask", "left", "around"])


def _adjacent(batches):
    """(v, bits, w, bit): of anchors in the order of ranks the strings that occur again, as bits; w and bit: one string, by its
    fingerprint, of an anchor whose run may go on in another task."""
    held: list[pa.RecordBatch] = []
    first = True

    def judged(table: pa.Table, last: bool):
        nonlocal first
        v, n, mask, left = (table.column(c).to_numpy() for c in ("v", "n", "mask", "left"))
        mask = mask.view(U64)
        flat, at = _flat(table.column("around"))
        prints, anchor = Prints(flat), at[:-1] + left
        # neighbours are compared by the bytes from the anchor on
        size = np.minimum(at[1:] - anchor, LENGTH)
        common = np.zeros(len(v), np.int64)  # with the one before
        a, b = anchor[:-1], anchor[1:]
        low, high = np.zeros(len(a), np.int64), np.minimum(size[:-1], size[1:])
        while (low < high).any():  # the longest common prefix by halving
            mid = (low + high + 1) // 2
            same = prints.of(a, a + mid) == prints.of(b, b + mid)
            low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
        common[1:] = low
        block = np.cumsum(common < SURE)  # runs that share the SURE bytes
        bits = np.zeros(len(v), U64)
        for d in range(WINDOW):
            here = np.flatnonzero(mask >> U64(d) & U64(1))
            if not len(here):
                continue
            run = np.cumsum(common < LENGTH - d)[here]
            own = prints.of(anchor[here] - d, anchor[here])
            order = np.lexsort((own, run))
            same = (run[order][1:] == run[order][:-1]) & (own[order][1:] == own[order][:-1])
            again = n[here] > 1
            again[order[1:][same]] = again[order[:-1][same]] = True
            bits[here[again]] |= U64(1) << U64(d)
        # runs at the borders of what a task has may go on elsewhere
        border = ((block == block[0]) & first) | ((block == block[-1]) & last)
        first = False
        out = [(v, bits.view(np.int64), np.zeros(len(v), np.int64), np.full(len(v), -1))]
        for d in range(WINDOW):
            here = np.flatnonzero(border & (mask >> U64(d) & U64(1) == 1))
            if len(here):
                start = anchor[here] - d
                w = prints.of(start, start + LENGTH).view(np.int64)
                # of those known to occur again one speaks for all
                known = bits[here] >> U64(d) & U64(1) == 1
                one = np.zeros(len(here), bool)
                one[np.flatnonzero(known)[np.unique(w[known], return_index=True)[1]]] = True
                keep = ~known | one
                here, w = here[keep], w[keep]
                out.append((v[here], np.zeros(len(here), np.int64), w, np.full(len(here), d)))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(np.int64)) for x in zip(*out)], ["v", "bits", "w", "bit"])

    count = 0
    for batch in batches:
        held.append(batch)
        count += batch.num_rows
        if count >= JUDGED:
            table = pa.Table.from_batches(held).combine_chunks()
            # keep the last run for the next round, as it may go on there
            flat, at = _flat(table.column("around"))
            anchor = at[:-1] + table.column("left").to_numpy()
            sure = Prints(flat).of(anchor, anchor + SURE)
            other = np.flatnonzero(sure != sure[-1])
            cut = int(other[-1]) + 1 if len(other) else 0
            if cut or count >= LONG_RUN:
                # a run too long to wait for is looked at as if it were split over tasks
                yield judged(table.slice(0, cut or count), not cut)
                held = table.slice(cut or count).to_batches()
                if not cut:
                    first = True
                count -= cut or count
    if count:
        yield judged(pa.Table.from_batches(held).combine_chunks(), True)


def _intervals(batches):
    """(g, spans): the bytes of stretches that are covered, from the bits of their places."""
    for row in _rows(batches):
        g, p = _opened(row)
        k, v, *_ = _places(g, p)
        known, bits = row.fields("hits", "v", "bits")
        order = np.argsort(known)
        bits = bits.view(U64)[order]
        slot = np.minimum(np.searchsorted(known[order], v), len(known) - 1)
        told = np.where(known[order][slot] == v, bits[slot], U64(0))
        which, d = np.nonzero((told[:, None] >> np.arange(WINDOW, dtype=U64)[None]) & U64(1) == 1)
        of = p.row[k[which]]
        starts = p.at[k[which]] - d - p.offsets[of]
        order = np.lexsort((starts, of))
        starts, cut = starts[order], np.searchsorted(of[order], np.arange(len(g) + 1))
        spans = [_merged(starts[a:b], LENGTH) for a, b in zip(cut.tolist(), cut[1:].tolist())]
        yield pa.RecordBatch.from_arrays([pa.array(g), pa.array(spans, pa.list_(pa.list_(pa.int32())))], ["g", "spans"])


def _merged(starts: np.ndarray, length: int) -> list[list[int]]:
    if not len(starts):
        return []
    head = np.concatenate([[True], starts[1:] > starts[:-1] + length])
    ends = np.concatenate([starts[np.flatnonzero(head)[1:] - 1], starts[-1:]]) + length
    return np.stack([starts[head], ends], 1).tolist()


def covered(texts: DataFrame) -> DataFrame:
    """(id, spans): of the texts (id, t) the bytes covered by a string of LENGTH bytes that another text or place has too,
    as pieces [first, end] that may meet."""
    found = stretches(texts)
    pieces = staged(found.groupBy("g").agg(F.first("bytes").alias("bytes"), F.count("*").alias("n")))
    parcels = sorted_suffixes(pieces.select("g", "bytes"))
    collected(texts.sparkSession)
    # how often each stretch is there, beside its parcel
    times = pieces.groupBy(_parcel_of(pieces).alias("p")).agg(F.collect_list(F.struct("g", "n")).alias("t"))
    placed = staged(parcels.join(times, "p").mapInArrow(_placed, "v long, p int, k int, n long"))
    # places with equal bytes all around are one, counted
    places = placed.groupBy("v").agg(F.min(F.struct("p", "k")).alias("at"), F.sum("n").alias("n"))
    asked = places.select("v", "at.p", "at.k", "n").groupBy("p").agg(F.collect_list(F.struct("v", "k", "n")).alias("asked"))
    collected(texts.sparkSession)
    contexts = staged(parcels.join(asked, "p").mapInArrow(_contexts, "v long, rank long, n long, mask long, left long, around binary"))
    ranges = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    judged = staged(contexts.repartitionByRange(ranges, "rank", "v").sortWithinPartitions("rank", "v").mapInArrow(_adjacent, "v long, bits long, w long, bit long"))
    discard(contexts)
    collected(texts.sparkSession)
    split = judged.where("bit >= 0")
    again = split.groupBy("w").agg(F.min(F.struct("v", "bit")).alias("a"), F.max(F.struct("v", "bit")).alias("b")).where("a <> b").select("w")
    more = split.join(again, "w", "left_semi").select("v", F.expr("shiftleft(1L, int(bit))").alias("bits"))
    bits = judged.where("bit < 0").select("v", "bits").unionByName(more).where("bits <> 0").groupBy("v").agg(F.bit_or("bits").alias("bits"))
    hits = placed.select("v", "p").join(bits, "v").groupBy("p").agg(F.collect_list(F.struct("v", "bits")).alias("hits"))
    spans = parcels.join(hits, "p").mapInArrow(_intervals, "g long, spans array<array<int>>").where(F.size("spans") > 0)
    shifted = F.transform("spans", lambda s: F.struct((s[0] + F.col("start")).alias("first"), (s[1] + F.col("start")).alias("end")))
    return found.select("id", "start", "g").join(spans, "g").select("id", shifted.alias("spans")).groupBy("id").agg(F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"))


def repeats(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with __id and __spans: the bytes of each text to remove, as pieces in order that may meet; null: none, and a
    text that several rows have goes whole."""
    small_batches(docs.sparkSession)
    told = docs.withColumn("__id", F.xxhash64(F.coalesce(F.col(text), F.lit(""))))
    texts = told.where(F.octet_length(text) >= LENGTH).select(F.col("__id").alias("id"), F.col(text).alias("t"))
    copies = texts.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id", F.array(F.struct(F.lit(0).alias("first"), F.lit(2**31 - 1).alias("end"))).alias("spans"))
    spans = covered(texts).join(copies.select("id"), "id", "left_anti").unionByName(copies)
    spans = staged(spans.withColumnsRenamed({"id": "__id", "spans": "__spans"}))
    few = spans.count() <= BROADCAST_ROWS
    return told.join(F.broadcast(spans) if few else spans, "__id", "left")


def digest(docs: DataFrame, key: str = "doc_id", text: str = "text", kept: str | None = None) -> DataFrame:
    """(key, n_bytes, n_removed, n_spans, kept_sha256) for each row; ``kept``: the name of a column for the bytes left."""
    found = repeats(docs.select(key, text), text).select(key, F.coalesce(F.col(text), F.lit("")).alias("__text"), "__spans")
    raw, kind = F.encode("__text", "UTF-8"), "struct<first: int, end: int, kept: binary, removed: int, spans: int>"
    start = F.struct(F.lit(0).alias("first"), F.lit(-1).alias("end"), F.lit(b"").alias("kept"), F.lit(0).alias("removed"), F.lit(0).alias("spans")).cast(kind)
    size = F.octet_length("__text")

    def step(done, s):
        first, end = F.greatest(s["first"], done["end"]), F.least(s["end"], size)
        fresh = s["first"] > done["end"]
        grown = F.struct(
            s["first"].alias("first"), F.greatest(end, done["end"]).alias("end"),
            F.when(fresh, F.concat(done["kept"], F.substr(raw, F.greatest(done["end"], F.lit(0)) + 1, s["first"] - F.greatest(done["end"], F.lit(0))))).otherwise(done["kept"]).alias("kept"),
            (done["removed"] + F.greatest(end - F.greatest(first, F.lit(0)), F.lit(0))).alias("removed"), (done["spans"] + F.when(fresh, 1).otherwise(0)).alias("spans"),
        )
        return grown.cast(kind)

    out = F.aggregate(F.coalesce("__spans", F.array().cast("array<struct<first: int, end: int>>")), start, step)
    done = found.select(key, size.cast("long").alias("n_bytes"), out.alias("o"), raw.alias("__raw"))
    left = F.concat("o.kept", F.substr("__raw", F.greatest(F.col("o.end"), F.lit(0)) + 1, F.lit(2**31 - 1)))
    out = done.select(key, "n_bytes", F.col("o.removed").cast("long").alias("n_removed"), F.col("o.spans").cast("long").alias("n_spans"), left.alias("__left"))
    named = [F.sha2("__left", 256).alias("kept_sha256"), *([F.col("__left").alias(kept)] if kept else [])]
    return out.select(key, "n_bytes", "n_removed", "n_spans", *named)
