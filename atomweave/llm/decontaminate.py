"""Benchmark decontamination by an FM-index of each shard of the training text.

A shard (about a MB of whole documents) becomes a sequence of symbols: words of the benchmark by number, every other
word and every document end a separator of its own.  Its suffix array is sorted by prefix doubling, where separators
end every comparison; the Burrows-Wheeler transform is held in a wavelet matrix whose ranks answer all backward
steps of all phrases at once.  Occurrences are found by stepping back to sampled suffix positions, and the words they
cover are merged into spans.

Defined results: null and empty texts have no words and are clean; texts of any length are searched whole.  Phrases of
fewer than ``width`` words are searched whole; an item without words matches nothing.  Equal items all count; the words
of an item without an id are hits, but it isn't named among the items.  Repeated rows, and rows that share a key or have
none, are answered each by their own text.  Empty tables give an empty result or clean documents.  The benchmark is
searched in blocks of bounded size, so it may be of any size; spans of all blocks are merged row by row.  Other columns
aren't looked at, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from atomweave.llm.common import slices, small_batches, staged, utf8
from atomweave.llm.words import ALNUM, bounds, words

#: Consecutive words of a phrase.
WIDTH = 13
#: Bytes of text in a shard of the index, and rows between kept suffix positions.
SHARD_BYTES = 1 << 20
SAMPLE = 8
#: Benchmark items, and bytes of them, searched in one pass; that bounds what is broadcast.
BLOCK_ITEMS, BLOCK_BYTES = 20_000, 32 << 20


class Bits:
    """A bit vector with rank."""

    def __init__(self, bits: np.ndarray):
        self.n = len(bits)
        padded = np.zeros((self.n // 64 + 1) * 64, np.uint8)
        padded[: self.n] = bits
        self.blocks = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.blocks), dtype=np.int64)])

    def get(self, at: np.ndarray) -> np.ndarray:
        return (self.blocks[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)

    def ones(self, at: np.ndarray) -> np.ndarray:
        """Set bits before each place."""
        part = self.blocks[at >> 6] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1))
        return self.before[at >> 6] + np.bitwise_count(part)


class WaveletMatrix:
    """Symbols by bit planes, highest first; rank and access go through all planes for many places at once."""

    def __init__(self, symbols: np.ndarray, high: int):
        self.levels: list[tuple[int, Bits, int]] = []
        for bit in range(max(1, int(high).bit_length()) - 1, -1, -1):
            on = (symbols >> bit) & 1 == 1
            self.levels.append((bit, Bits(on), int(len(on) - np.count_nonzero(on))))
            symbols = np.concatenate([symbols[~on], symbols[on]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each place."""
        start = np.zeros_like(at)
        for bit, bits, zeros in self.levels:
            on = (symbol >> bit) & 1 == 1
            one_at, one_start = bits.ones(at), bits.ones(start)
            at = np.where(on, zeros + one_at, at - one_at)
            start = np.where(on, zeros + one_start, start - one_start)
        return at - start

    def access(self, at: np.ndarray) -> np.ndarray:
        out = np.zeros_like(at)
        for bit, bits, zeros in self.levels:
            on = bits.get(at) == 1
            one = bits.ones(at)
            out |= on.astype(np.int64) << bit
            at = np.where(on, zeros + one, at - one)
        return out


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Places in the order of their suffixes; each 0 differs from every other and precedes all other symbols.

    Prefix doubling: only suffixes whose first 2^k symbols they share with another are compared further."""
    n = len(symbols)
    zero = symbols == 0
    order = np.concatenate([np.flatnonzero(zero), (rest := np.flatnonzero(~zero))[np.argsort(symbols[rest], kind="stable")]])
    zeros = n - len(rest)
    head = np.ones(n, bool)
    own = symbols[order]
    head[zeros + 1 :] = own[zeros + 1 :] != own[zeros:-1] if n > zeros else head[zeros + 1 :]
    rank = np.empty(n + 1, np.int64)
    rank[n] = -1
    rank[order] = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    width = 1
    tied = np.flatnonzero(~head | np.append(~head[1:], False))
    while len(tied):
        place = order[tied]
        first, second = rank[place], rank[np.minimum(place + width, n)]
        by = np.lexsort((second, first))
        place, first, second = place[by], first[by], second[by]
        order[tied] = place
        new = np.ones(len(tied), bool)
        new[1:] = (first[1:] != first[:-1]) | (second[1:] != second[:-1])
        rank[place] = np.maximum.accumulate(np.where(new, tied, 0))
        same = ~new | np.append(~new[1:], False)
        tied = tied[same]
        width *= 2
    return order


class FmIndex:
    """Backward search and location over a sequence in which 0 separates."""

    def __init__(self, symbols: np.ndarray, high: int):
        sa = suffix_array(symbols)
        self.n = len(symbols)
        last = symbols[sa - 1]
        self.tree = WaveletMatrix(last, high)
        self.less = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=high + 1))])
        kept = (sa % SAMPLE == 0) | (last == 0)  # separators aren't ranked by what follows, so no step crosses one
        self.kept, self.places = Bits(kept), sa[kept]

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows [low, high) of the suffixes that begin with each phrase; phrases are rows, padded at the front."""
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n)
        for step in range(phrases.shape[1]):
            live = np.flatnonzero((lengths > step) & (low < high))
            if not len(live):
                break
            c = phrases[live, phrases.shape[1] - 1 - step]
            low[live] = self.less[c] + self.tree.rank(c, low[live])
            high[live] = self.less[c] + self.tree.rank(c, high[live])
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Places of suffixes: step back until a kept one."""
        out, steps, row = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64), rows.copy()
        live = np.arange(len(rows))
        while len(live):
            r = row[live]
            kept = self.kept.get(r) == 1
            out[live[kept]] = self.places[self.kept.ones(r[kept])] + steps[live[kept]]
            live, r = live[~kept], r[~kept]
            c = self.tree.access(r)
            row[live] = self.less[c] + self.tree.rank(c, r)
            steps[live] += 1
        return out


def phrase_table(texts: list[str | None], width: int = WIDTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes of the phrases (sorted), distinct phrases as word numbers from 1 on padded at the front, their lengths,
    and which items (at, flat) hold each phrase."""
    data, offsets = utf8(pa.array(texts, pa.string()))
    hashes, _, _, rows = words(data, offsets, ALNUM)
    at = bounds(rows, len(texts))
    known = np.unique(hashes)
    number = np.searchsorted(known, hashes) + 1
    held: dict[bytes, list[int]] = {}
    for i in range(len(texts)):
        own = number[at[i] : at[i + 1]]
        for s in range(max(0, len(own) - width) + 1 if len(own) else 0):
            items = held.setdefault(own[s : s + width].tobytes(), [])
            if not items or items[-1] != i:
                items.append(i)
    lengths = np.array([len(k) // 8 for k in held], np.int64)
    phrases = np.zeros((len(held), width), np.int64)
    for row, k in enumerate(held):
        phrases[row, width - len(k) // 8 :] = np.frombuffer(k, np.int64)
    return known, phrases, lengths, np.concatenate([[0], np.cumsum([len(x) for x in held.values()])]).astype(np.int64), np.array([i for x in held.values() for i in x], np.int64)


def search_shard(data: np.ndarray, offsets: np.ndarray, table) -> tuple[np.ndarray, np.ndarray, list, list]:
    """For each row of a shard: its words, the words inside occurrences, the merged spans of those, and its items."""
    known, phrases, lengths, item_at, item_flat = table
    n = len(offsets) - 1
    hashes, _, _, rows = words(data, offsets, ALNUM)
    at = bounds(rows, n)
    counts = np.diff(at)
    spans, items = [[] for _ in range(n)], [[] for _ in range(n)]
    if not len(hashes) or not len(phrases):
        return counts, np.zeros(n, np.int64), spans, items
    slot = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
    number = np.where(known[slot] == hashes, slot + 1, 0)
    # a separator goes before every row, so that the word at place p of the sequence is word p - row - 1
    symbols = np.zeros(len(number) + n + 1, np.int64)
    symbols[np.arange(len(number)) + rows + 1] = number
    index = FmIndex(symbols, len(known))
    low, high = index.search(phrases, lengths)
    found = np.flatnonzero(low < high)
    per = (high - low)[found]
    phrase = np.repeat(found, per)
    place_rows = np.repeat(low[found] - np.concatenate([[0], np.cumsum(per)[:-1]]), per) + np.arange(per.sum())
    place = index.locate(place_rows)
    row = np.searchsorted(at + np.arange(n + 1), place, "right") - 1
    word = place - row - 1
    cover = np.zeros(len(hashes) + 1, np.int64)
    np.add.at(cover, word, 1)
    np.add.at(cover, word + lengths[phrase], -1)
    hit = np.cumsum(cover)[:-1] > 0
    n_hit = np.bincount(rows, weights=hit, minlength=n).astype(np.int64)
    edge = hit.copy()
    edge[1:] &= ~hit[:-1] | (rows[1:] != rows[:-1])
    stop = hit.copy()
    stop[:-1] &= ~hit[1:] | (rows[1:] != rows[:-1])
    for a, b in zip(np.flatnonzero(edge).tolist(), np.flatnonzero(stop).tolist()):
        spans[rows[a]].append((a - int(at[rows[a]]), b + 1 - int(at[rows[a]])))
    for r, p in set(zip(row.tolist(), phrase.tolist())):
        items[r].extend(item_flat[item_at[p] : item_at[p + 1]].tolist())
    return counts, n_hit, spans, [sorted(set(x)) for x in items]


def find(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", width: int = WIDTH) -> DataFrame:
    """key, n_words, spans (array of first and end word) and items (array of item ids as text, sorted as text)."""
    spark = docs.sparkSession
    small_batches(spark)
    ranged = benchmark.select(F.col(item).cast("string").alias("i"), F.col(item_text).alias("t"))
    docs = docs.select(F.col(key).alias("key"), F.col(text).alias("t"), F.lit(0).cast("long").alias("row"))
    size = ranged.agg(F.count("*").alias("n"), F.sum(F.octet_length("t")).alias("bytes")).first()
    if size["n"] > BLOCK_ITEMS or (size["bytes"] or 0) > BLOCK_BYTES:  # each row needs a name of its own, to be found again
        docs = staged(docs.withColumn("row", F.monotonically_increasing_id()))
    schema = T.StructType([docs.schema["key"], docs.schema["row"], T.StructField("n_words", T.LongType()), *T.StructType.fromDDL("spans array<struct<first: long, end: long>>, items array<string>")])
    parts = []
    for names, texts in _blocks(ranged):
        shared = spark.sparkContext.broadcast((names, *phrase_table(texts, width)))

        def run(batches, shared=shared):
            names, *table = shared.value
            for whole in batches:
                for batch in slices(whole, "t", SHARD_BYTES):
                    counts, _, spans, items = search_shard(*utf8(batch.column(1)), table)
                    made = [pa.array(counts, pa.int64()), pa.array([[{"first": a, "end": b} for a, b in x] for x in spans], _SPANS), pa.array([sorted({names[i] for i in x} - {None}) for x in items], pa.list_(pa.string()))]
                    yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *made], schema.names)

        parts.append(docs.mapInArrow(run, schema))
    if len(parts) == 1:
        return parts[0].drop("row").withColumnRenamed("key", key)
    # several blocks: a row's spans of all of them are merged; a row has one part from each
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    merged = F.aggregate(
        F.array_sort(F.flatten(F.collect_list("spans"))),
        F.array().cast("array<struct<first: long, end: long>>"),
        lambda done, x: F.when((F.size(done) > 0) & (F.try_element_at(done, F.lit(-1))["end"] >= x["first"]), F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(F.struct(F.try_element_at(done, F.lit(-1))["first"].alias("first"), F.greatest(F.try_element_at(done, F.lit(-1))["end"], x["end"]).alias("end"))))).otherwise(F.concat(done, F.array(x))),
    )
    found = both.groupBy("row").agg(F.first("key").alias(key), F.max("n_words").alias("n_words"), merged.alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    return found.drop("row")


_SPANS = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))


def _blocks(benchmark: DataFrame) -> Iterator[tuple[list[str | None], list[str | None]]]:
    """Items in blocks of at most BLOCK_ITEMS and, but for single ones, BLOCK_BYTES, read as they are asked for; at least one block, be it empty."""
    names, texts, size, given = [], [], 0, False
    for r in benchmark.orderBy("i", "t").toLocalIterator():
        more = len((r["t"] or "").encode("utf-8", "replace"))
        if names and (len(names) == BLOCK_ITEMS or size + more > BLOCK_BYTES):
            yield names, texts
            names, texts, size, given = [], [], 0, True
        names.append(r["i"])
        texts.append(r["t"])
        size += more
    if names or not given:
        yield names, texts


def judge(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", **kw) -> DataFrame:
    """find()'s columns, n_hit, n_items, items_sha256 and contaminated (a twentieth of the words or more are hit)."""
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["first"])
    return find(docs, benchmark, key, text, **kw).select(
        key,
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"),
        "spans",
        "items",
    )


def remove(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", **kw) -> DataFrame:
    """The documents that aren't contaminated, unchanged; rows that share a key and a text are judged alike, others by
    their own text."""
    told = docs.select(F.struct(F.col(key).alias("k"), F.xxhash64(text).alias("h")).alias("__name"), F.col(text).alias("__text"))
    bad = judge(told, benchmark, "__name", "__text", **kw).where("contaminated").select("__name").distinct()
    named = docs.withColumn("__name", F.struct(F.col(key).alias("k"), F.xxhash64(text).alias("h")))
    return named.join(bad, named["__name"].eqNullSafe(bad["__name"]), "left_anti").drop("__name")
