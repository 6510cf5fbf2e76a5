"""Exact self-join of documents by the Jaccard similarity of their word shingles, vertically partitioned.

The universe of shingles has one global order: those that many documents hold (by sums of 2^16 classes over the whole
corpus) come last, all others by hash.  The order is cut into fragments; what a document holds of each fragment of its
prefix is counted apart, and overlaps are summed per pair.  A pair as similar as asked shares at least
``min(p_a - a, p_b - b) + o`` prefix shingles (p: prefix, a and b: set sizes, o: least overlap), so a pair whose sum
stays below that is dropped; the others are compared exactly on their whole texts.  Two sets meet only if the parities
of their shingles in BITS classes allow the overlap: where those differ, at least one set has a shingle of its own.

Large groups never become all pairs.  Equal sets are one class from the start.  A light first round links sets to the
least and greatest holder of their least hashes and verifies those links; in the fragments only shingles that two
*different* components hold still count, and of these the component that holds one most often isn't paired with itself.
No link between sets of different components is lost that way, so components are exact.

Shingle and set identities are 64-bit hashes.  Defined results: null, empty and wordless texts have n_shingles 0 and
are linked with nothing (their own component); fewer words than a shingle are one shingle; texts of any length count
whole; an empty table gives an empty result.  Repeated rows are answered each; rows that repeat a key are one document,
so its texts share a component.  A row without a key is answered with its n_shingles and a null component and linked
with nothing.  Ties do not arise: a class is named by its least key.  Columns beyond key and text aren't looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from atomweave.llm.common import BROADCAST_ROWS, slices, small_batches, staged, utf8
from atomweave.llm.graph import components
from atomweave.llm.words import SPACED, bounds, mix, shingles, words

#: Words of a shingle, and similarity in hundredths.
SHINGLE, PERCENT = 5, 75
#: Classes over which shingle frequency is summed, least hashes for the first round, postings of a fragment.
CLASSES, RAREST, FRAGMENT_ROWS = 1 << 16, 8, 500_000
#: Parities kept of a set; whole 64-bit integers of them.
BITS = 512
#: Contested shingles that are broadcast; more of them are joined by a shuffle.
CONTESTED_ROWS = 1_500_000


def sets_of(batch: pa.RecordBatch, text: str, k: int = SHINGLE) -> list[np.ndarray]:
    """The distinct shingles of each row, sorted."""
    hashes, _, _, rows = words(*utf8(batch.column(batch.schema.get_field_index(text))), SPACED)
    flat, at = shingles(hashes, bounds(rows, batch.num_rows), k)
    return [np.unique(flat[a:b]) for a, b in zip(at, at[1:])]


def _class(h: np.ndarray) -> np.ndarray:
    return (h & np.uint64(CLASSES - 1)).astype(np.int64)


def summarize(docs: DataFrame, key: str, text: str, k: int) -> DataFrame:
    """Rows (key, n, s, rarest) of documents, and rows (class, n) of how many distinct shingles a task saw in a class."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        seen = np.zeros(CLASSES, np.int64)
        for whole in batches:
            for batch in slices(whole, text):
                sets = sets_of(batch, text, k)
                if any(map(len, sets)):
                    seen += np.bincount(_class(np.concatenate(sets)), minlength=CLASSES)
                signs = [int(mix(np.bitwise_xor.reduce(mix(x), keepdims=True))[0].astype(np.int64)) if len(x) else 0 for x in sets]
                rare = [x[:RAREST].astype(np.int64) for x in sets]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(batch.schema.get_field_index(key)), pa.array(map(len, sets), pa.int64()), pa.array(signs, pa.int64()), pa.array(rare, pa.list_(pa.int64())), pa.nulls(len(sets), pa.int32())],
                    [key, "n", "s", "rarest", "class"],
                )
        full = np.flatnonzero(seen)
        none = len(full)
        yield pa.RecordBatch.from_arrays([pa.nulls(none, batch_type[key]), pa.array(seen[full], pa.int64()), pa.nulls(none, pa.int64()), pa.nulls(none, pa.list_(pa.int64())), pa.array(full, pa.int32())], [key, "n", "s", "rarest", "class"])

    batch_type = {key: pa.int64() if kind == "bigint" else pa.int32() if kind == "int" else pa.string()}
    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, n long, s long, rarest array<long>, class int")


def verified(docs: DataFrame, pairs: DataFrame, key: str, text: str, k: int, percent: int) -> DataFrame:
    """The pairs (x, y) of keys whose texts are similar, compared shingle by shingle on their whole texts."""
    ids = staged(pairs.select(F.col("x").alias("id")).union(pairs.select("y")).distinct())
    few = ids.count() <= BROADCAST_ROWS
    texts = docs.select(F.col(key).alias("id"), F.col(text).alias("t")).join(F.broadcast(ids) if few else ids, "id", "left_semi")
    both = pairs.join(texts.select(F.col("id").alias("x"), F.col("t").alias("tx")), "x").join(texts.select(F.col("id").alias("y"), F.col("t").alias("ty")), "y").select("x", "y", "tx", "ty")

    def run(batches):
        for whole in batches:
            for batch in slices(whole, "tx"):
                left, names = sets_of(batch, "tx", k), batch.column(1).to_pylist()
                fresh = changes(names, batch.column(3))  # rows come sorted by y
                right = sets_of(batch.take(pa.array(fresh)), "ty", k)
                which = np.searchsorted(fresh, np.arange(len(names)), "right") - 1
                keep = []
                for i, a in enumerate(left):
                    b = right[which[i]]
                    common = _common(a, b)
                    if common and 100 * common >= percent * (len(a) + len(b) - common):
                        keep.append(i)
                yield batch.select([0, 1]).take(pa.array(keep, pa.int64()))

    return both.mapInArrow(run, both.select("x", "y").schema)


def changes(names: list, column: pa.Array) -> list[int]:
    """The rows whose name or text isn't that of the row before."""
    same = pc.equal(column.slice(1), column.slice(0, max(0, len(column) - 1))).to_pylist()
    return [i for i, y in enumerate(names) if not i or y != names[i - 1] or not same[i - 1]]


def _common(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if not len(a) or not len(b):
        return 0
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int(np.count_nonzero(b[at] == a))


def prefix_length(n: np.ndarray, percent: int) -> np.ndarray:
    """Of a set of n shingles, so many of the first ones include one of any similar set's."""
    return n - -(-percent * n // 100) + 1


def _prefixes(sets: list[np.ndarray], late: np.ndarray, percent: int) -> list[np.ndarray]:
    """The first shingles of each set in the global order."""
    out = []
    for x in sets:
        p = int(prefix_length(np.int64(len(x)), percent)) if len(x) else 0
        behind = late[_class(x)]
        out.append((x[np.argsort(behind, kind="stable")] if behind.any() else x)[:p])
    return out


def parities(sets: list[np.ndarray]) -> np.ndarray:
    """For each set a row of BITS / 64 integers: whether it has an odd number of shingles in each class."""
    row = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    flat = mix(np.concatenate(sets)) if sets else np.zeros(0, np.uint64)
    odd = np.bincount(row * BITS + (flat >> np.uint64(64 - BITS.bit_length() + 1)).astype(np.int64), minlength=len(sets) * BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64).reshape(len(sets), BITS // 64)


def _fragment(h: np.ndarray, late: np.ndarray, fragments: int) -> np.ndarray:
    """Fragments are ranges of hashes; the ranges of late shingles follow those of all others."""
    own = ((h >> np.uint64(32)) * np.uint64(fragments) >> np.uint64(32)).astype(np.int64)
    return own + fragments * (late[_class(h)] > 0)


def _keys(h: np.ndarray, fragment: np.ndarray) -> np.ndarray:
    return fragment << 32 | (mix(h) & np.uint64(0xFFFFFFFF)).astype(np.int64)


def contested(docs: DataFrame, late: np.ndarray, fragments: int, k: int, percent: int) -> DataFrame:
    """(key, main): prefix shingles, as key in their fragment, of more than one component, and the one seen most often.

    Tasks reduce their documents to one row for each shingle and component, packed by fragment, before any is dealt out."""
    shared = docs.sparkSession.sparkContext.broadcast(late)

    def run(batches):
        late = shared.value
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def packed():
            key, comp = (np.concatenate(x) for x in zip(*held))
            held.clear()
            order = np.lexsort((comp, key))
            key, comp = key[order], comp[order]
            new = np.ones(len(key), bool)
            new[1:] = (key[1:] != key[:-1]) | (comp[1:] != comp[:-1])
            key, comp = key[new], comp[new]
            cut = np.flatnonzero(np.diff(key >> 32, prepend=-1))
            ends = [*cut[1:].tolist(), len(key)]
            blobs = [(key[a:b] & 0xFFFFFFFF).astype("<u4").tobytes() + comp[a:b].astype("<i8").tobytes() for a, b in zip(cut.tolist(), ends)]
            return pa.RecordBatch.from_arrays([pa.array(key[cut] >> 32, pa.int64()), pa.array(blobs, pa.binary())], ["f", "rows"])

        size = 0
        for whole in batches:
            for batch in slices(whole, "t"):
                first = _prefixes(sets_of(batch, "t", k), late, percent)
                flat = np.concatenate(first)
                if len(flat):
                    held.append((_keys(flat, _fragment(flat, late, fragments)), np.repeat(batch.column(1).to_numpy(), [len(x) for x in first])))
                    size += len(flat)
                if size > 1_000_000:
                    yield packed()
                    size = 0
        if held:
            yield packed()

    def reduce(table: pa.Table) -> pa.Table:
        f = table.column(0)[0].as_py() if table.num_rows else 0
        blobs = table.column(1).to_pylist()
        sizes = [len(b) // 12 for b in blobs]
        key = np.concatenate([np.frombuffer(b, "<u4", n) for b, n in zip(blobs, sizes)])
        comp = np.concatenate([np.frombuffer(b, "<i8", n, 4 * n) for b, n in zip(blobs, sizes)])
        order = np.lexsort((comp, key))
        key, comp = key[order], comp[order]
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (comp[1:] != comp[:-1])
        at = np.flatnonzero(new)
        often, key, comp = np.diff(at, append=len(new)), key[at], comp[at]
        # of each key with several components, the one in most packets, the least of those
        order = np.lexsort((comp, -often, key))
        key, comp = key[order], comp[order]
        first = np.ones(len(key), bool)
        first[1:] = key[1:] != key[:-1]
        several = first.copy()
        several[:-1] &= ~first[1:]
        several[-1:] = False
        return pa.table({"key": pa.array(f << 32 | key[several].astype(np.int64), pa.int64()), "main": pa.array(comp[several], pa.int64())})

    packets = docs.select(F.col("t"), "comp", "id").select("t", "comp").mapInArrow(run, "f long, rows binary")
    return packets.groupBy("f").applyInArrow(reduce, "key long, main long")


def postings(docs: DataFrame, late: np.ndarray, fragments: int, k: int, percent: int, wanted: tuple[np.ndarray, np.ndarray] | None) -> DataFrame:
    """(key, main, id, comp, n, p0, p1, ...) of prefix shingles, with the parities of their sets; with ``wanted`` (keys, mains) only of these."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((late, wanted))

    def run(batches):
        late, wanted = shared.value
        for whole in batches:
            for batch in slices(whole, "t"):
                sets = sets_of(batch, "t", k)
                first = _prefixes(sets, late, percent)
                per = np.array([len(x) for x in first])
                flat = np.concatenate(first)
                key = _keys(flat, _fragment(flat, late, fragments))
                main = np.full(len(key), -1, np.int64)
                row = np.repeat(np.arange(len(sets)), per)
                if wanted is not None:
                    at = np.searchsorted(wanted[0], key)
                    at[at == len(wanted[0])] = 0
                    hit = wanted[0][at] == key if len(wanted[0]) else np.zeros(len(key), bool)
                    key, main, row = key[hit], wanted[1][at[hit]], row[hit]
                n = np.array([len(x) for x in sets], np.int64)
                odd = parities(sets)[row]
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (key, main, batch.column(2).to_numpy()[row], batch.column(1).to_numpy()[row], n[row], *odd.T)], names)

    names = ["key", "main", "id", "comp", "n", *(f"p{i}" for i in range(BITS // 64))]
    return docs.select("t", "comp", "id").mapInArrow(run, ", ".join(f"{c} long" for c in names))


def candidates(rows: DataFrame, percent: int) -> DataFrame:
    """Pairs (x, y) of different components whose partial overlaps, summed over all fragments, reach their bound."""
    own = range(BITS // 64)
    a = rows.where("comp <> main").select("key", F.col("id").alias("x"), F.col("comp").alias("cx"), F.col("n").alias("nx"), *(F.col(f"p{i}").alias(f"x{i}") for i in own))
    b = rows.select("key", F.col("id").alias("y"), F.col("comp").alias("cy"), F.col("n").alias("ny"), (F.col("comp") == F.col("main")).alias("in_main"), *(F.col(f"p{i}").alias(f"y{i}") for i in own))
    near = (F.col("nx") * 100 >= F.col("ny") * percent) & (F.col("ny") * 100 >= F.col("nx") * percent)
    # each class whose parities differ has a shingle that one of the two lacks
    apart = sum((F.bit_count(F.col(f"x{i}").bitwiseXOR(F.col(f"y{i}"))) for i in own), F.lit(0))
    near &= apart * (100 + percent) <= (F.col("nx") + F.col("ny")) * (100 - percent)
    met = a.join(b, (a["key"] == b["key"]) & (F.col("cx") != F.col("cy")) & near & (F.col("in_main") | (F.col("x") < F.col("y"))))
    summed = met.groupBy(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).agg(F.count("*").alias("k"), F.max(F.when(F.col("x") < F.col("y"), F.col("nx")).otherwise(F.col("ny"))).alias("a"), F.max(F.when(F.col("x") < F.col("y"), F.col("ny")).otherwise(F.col("nx"))).alias("b"))
    least = F.ceil((F.col("a") + F.col("b")) * percent / (100.0 + percent) - 1e-9)
    prefix = lambda c: F.col(c) - F.ceil(F.col(c) * percent / 100.0 - 1e-9) + 1
    return summed.where(F.col("k") >= F.least(prefix("a") - F.col("a"), prefix("b") - F.col("b")) + least).select("x", "y")


def join(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """(key, n_shingles, component_id) of every row; the key is a whole number."""
    small_batches(docs.sparkSession)
    docs = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("t"))
    told = staged(summarize(docs, "id", "t", k))
    docs = docs.where("id IS NOT NULL")
    rows = told.where(F.col("class").isNull()).drop("class")
    full = rows.where("n > 0 AND id IS NOT NULL")
    sums = told.where(F.col("class").isNotNull()).groupBy("class").agg(F.sum("n").alias("n"))
    total = sums.agg(F.sum("n")).first()[0] or 0
    mean = total / CLASSES
    most = mean + 8 * mean**0.5 + 16
    late = np.zeros(CLASSES, np.uint8)
    for r in sums.where(F.col("n") > most).collect():
        late[r["class"]] = min(63, 1 + int(4 * np.log2(r["n"] / most)))
    sets = staged(full.groupBy("s", "n").agg(F.min("id").alias("id"), F.min("rarest").alias("rarest")))

    # the first round: links to the least and the greatest holder of rare shingles
    rare = sets.select("id", "n", F.explode("rarest").alias("h"))
    ends = rare.groupBy("h").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo < hi")
    met = rare.join(ends, "h").select("id", "n", F.explode(F.array("lo", "hi")).alias("y")).where("id <> y")
    met = met.groupBy(F.least("id", "y").alias("x"), F.greatest("id", "y").alias("y")).agg(F.count("*").alias("k"), F.min("n").alias("n")).where(F.col("k") >= F.least(F.lit(3), F.col("n"))).select("x", "y")
    linked = staged(verified(docs, staged(met), "id", "t", k, percent))
    groups = staged(components(linked))

    # the fragments: one document of each set, with its component
    copies = full.select("id", "s", "n").distinct().join(sets.select("s", "n", F.col("id").alias("rep")), ["s", "n"])
    each = staged(copies.select("id", "rep"))
    copies = staged(each.groupBy("id").agg(F.min("rep").alias("rep"), F.count("*").alias("texts")))
    # a key of several texts is linked with what each of them is a copy of
    alike = each.join(copies.where("texts > 1").select("id"), "id", "left_semi").select(F.col("id").alias("x"), F.col("rep").alias("y"))
    notes = copies.where("id <> rep AND texts = 1").select("id", F.lit(None).cast("long").alias("comp"), F.lit(True).alias("copy")).unionByName(groups.select("id", F.col("component").alias("comp"), F.lit(False).alias("copy")))
    notes = staged(notes)
    few = notes.count() <= BROADCAST_ROWS
    own = docs.join(F.broadcast(notes) if few else notes, "id", "left").where(~F.coalesce("copy", F.lit(False))).select("id", F.coalesce("comp", "id").alias("comp"), "t")
    fragments = max(16, -(-total * (100 - percent) // 100 // FRAGMENT_ROWS))
    open_ = staged(contested(own, late, fragments, k, percent))
    if open_.count() <= CONTESTED_ROWS:
        got = open_.toArrow()
        keys, mains = (got.column(c).to_numpy() for c in ("key", "main"))
        order = np.argsort(keys, kind="stable")
        shown = postings(own, late, fragments, k, percent, (keys[order], mains[order]))
        del got, keys, mains, order
    else:
        shown = postings(own, late, fragments, k, percent, None).drop("main").join(open_, "key")
    more = verified(docs, staged(candidates(staged(shown), percent)), "id", "t", k, percent)
    final = components(staged(linked.unionByName(more).unionByName(alike)))
    named = copies.join(final.withColumnRenamed("id", "rep"), "rep", "left").select("id", F.coalesce("component", "rep").alias("component"))
    return rows.select("id", "n").join(named, "id", "left").select(F.col("id").alias(key), F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component_id"))


def distinct(docs: DataFrame, key: str = "doc_id", text: str = "text", **kw) -> DataFrame:
    """One document of each component, unchanged: the one with the least key."""
    gone = join(docs, key, text, **kw).where(F.col(key) != F.col("component_id")).select(key).distinct()
    return docs.join(gone, key, "left_anti")
