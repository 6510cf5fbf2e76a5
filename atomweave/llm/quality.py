"""Quality by importance resampling: hashed n-gram models of target and raw text, and Gumbel top-k.

All words and word pairs of a text fall into 2^16 classes.  The target model counts those of the texts labelled good,
the raw model those of all texts; a text's log weight is the mean log ratio of its n-grams, carried to LENGTH n-grams
so that long and short texts compare.  Adding Gumbel noise, drawn from a hash of the key, and keeping the k greatest
sums samples k texts without replacement in proportion to their weights.  The cut is found exactly by counting sums in
ever finer ranges, so nothing but counts reaches the driver.

Counts cover all rows.  Defined results: null and wordless texts have no n-gram, weight minus infinity (null in the
result) and are never selected; texts of any length count whole; without any labelled text all weights are 0; an empty
table gives an empty result.  Equal sums go to the smaller key (none before any).  Rows that repeat a key, or have none,
share its noise; of rows equal in key and sum, only as many are selected as are needed.  Other columns aren't looked at,
whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from atomweave.llm.common import BROADCAST_ROWS, slices, staged, utf8
from atomweave.llm.words import SPACED, bounds, mix, words

CLASSES, LENGTH, SMOOTHING = 1 << 16, 200, 1.0
#: Share of the texts to be sampled, and the seed of the noise.
SHARE, SEED = 0.5, 20


def ngrams(batch: pa.RecordBatch, text: str) -> tuple[np.ndarray, np.ndarray]:
    """Classes of all words and pairs of words, and their offsets by row."""
    hashes, _, _, rows = words(*utf8(batch.column(batch.schema.get_field_index(text))), SPACED)
    pairs = mix(hashes[:-1] * np.uint64(0x9E3779B97F4A7C15) + hashes[1:])
    whole = np.flatnonzero(rows[:-1] == rows[1:])
    own = np.concatenate([rows, rows[whole]])
    order = np.argsort(own, kind="stable")
    return (np.concatenate([hashes, pairs[whole]])[order] >> np.uint64(48)).astype(np.int64), bounds(own[order], batch.num_rows)


def fit(docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text") -> np.ndarray:
    """Log ratio of every class; ``target``: the keys of good texts."""
    good = staged(target.select(F.col(key).alias("k")).where(F.col("k").isNotNull()).distinct())
    few = good.count() <= BROADCAST_ROWS
    marked = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).join((F.broadcast(good) if few else good).withColumn("good", F.lit(True)), "k", "left").select("t", F.coalesce("good", F.lit(False)).alias("good"))

    def run(batches):
        seen = np.zeros((2, CLASSES), np.int64)
        for whole in batches:
            for batch in slices(whole, "t"):
                classes, at = ngrams(batch, "t")
                mark = np.repeat(np.array(batch.column(1).to_pylist(), bool), np.diff(at))
                seen[0] += np.bincount(classes, minlength=CLASSES)
                seen[1] += np.bincount(classes[mark], minlength=CLASSES)
        full = np.flatnonzero(seen[0])
        yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array(seen[0][full]), pa.array(seen[1][full])], ["c", "raw", "target"])

    counts = np.zeros((2, CLASSES))
    for r in marked.mapInArrow(run, "c int, raw long, target long").groupBy("c").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).collect():
        counts[:, r["c"]] = r["raw"], r["target"]
    if not counts[1].sum():
        return np.zeros(CLASSES)
    share = (counts + SMOOTHING) / (counts.sum(1, keepdims=True) + SMOOTHING * CLASSES)
    return np.log(share[1] / share[0])


def score(docs: DataFrame, ratios: np.ndarray, key: str = "doc_id", text: str = "text", seed: int = SEED) -> DataFrame:
    """(key, log_weight, noisy): the weight and its sum with the row's Gumbel noise; null for texts without words."""
    shared = docs.sparkSession.sparkContext.broadcast(ratios)
    schema = T.StructType([docs.schema[key], T.StructField("log_weight", T.DoubleType())])

    def run(batches):
        ratio = shared.value
        for whole in batches:
            for batch in slices(whole, text):
                classes, at = ngrams(batch, text)
                n = np.diff(at)
                sums = np.add.reduceat(np.append(ratio[classes], 0.0), np.minimum(at[:-1], len(classes)))
                weight = np.where(n > 0, LENGTH * sums / np.maximum(n, 1), 0.0)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(weight, pa.float64(), mask=n == 0)], [key, "log_weight"])

    scored = docs.select(key, text).mapInArrow(run, schema)
    uniform = (F.pmod(F.xxhash64(F.col(key).cast("string"), F.lit(seed)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    return scored.withColumn("noisy", F.col("log_weight") - F.log(-F.log(uniform)))


def top(scored: DataFrame, k: int, value: str, key: str, row: str) -> Column:
    """Whether a row is among the k of greatest value (then least key, then least ``row``, which no two share): the condition
    on ``scored``, found by counting."""
    some = scored.where(F.col(value).isNotNull())
    ends = some.agg(F.min(value).alias("lo"), F.max(value).alias("hi"), F.count("*").alias("n")).first()
    if k <= 0 or not ends["n"]:
        return F.lit(False)
    if k >= ends["n"]:
        return F.col(value).isNotNull()
    lo, hi, need = ends["lo"], ends["hi"], k
    while lo < hi and (step := (hi - lo) / 1024) > 0 and lo + step > lo:
        place = F.least(F.floor((F.col(value) - lo) / step), F.lit(1023))
        counts = {r["p"]: r for r in some.where(F.col(value).between(lo, hi)).groupBy(place.alias("p")).agg(F.count("*").alias("n"), F.min(value).alias("lo"), F.max(value).alias("hi")).collect()}
        for p in sorted(counts, reverse=True):
            if counts[p]["n"] >= need:
                break
            need -= counts[p]["n"]
        if (lo, hi) == (counts[p]["lo"], counts[p]["hi"]):
            break
        lo, hi = counts[p]["lo"], counts[p]["hi"]
        if counts[p]["n"] == need:
            return F.coalesce(F.col(value) >= lo, F.lit(False))
    # rows of about one value: as many of the first ones as are still needed
    last = some.where(F.col(value).between(lo, hi)).orderBy(F.desc(value), F.asc_nulls_first(key), row).limit(need).agg(F.max(F.struct((-F.col(value)).alias("v"), F.col(key).isNotNull().alias("named"), F.col(key).alias("k"), F.col(row).alias("r")))).first()[0]
    v, this, other = F.lit(-last["v"]), F.col(key), F.lit(last["k"])
    before = this.isNull() & (F.lit(last["named"]) | (F.col(row) <= last["r"])) | this.isNotNull() & F.lit(last["named"]) & ((this < other) | (this == other) & (F.col(row) <= last["r"]))
    return F.coalesce((F.col(value) > v) | (F.col(value) == v) & F.coalesce(before, F.lit(False)), F.lit(False))


def resample(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", share: float = SHARE) -> DataFrame:
    """(key, log_weight, noisy, selected) for every row, sampling ``share`` of the texts that have words."""
    ratios = fit(docs, labels.where(F.col(label) > 0), key, text)
    scored = staged(score(docs, ratios, key, text).withColumn("__row", F.monotonically_increasing_id()))
    return scored.withColumn("selected", top(scored, int(share * scored.where(F.col("log_weight").isNotNull()).count()), "noisy", key, "__row")).drop("__row")
