"""Running numbers and carried values over keys of any size: blocks of a key are worked on apart, and short tables of
counts and last values by block say where each begins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from atomweave.operators.ranges import whole

#: Blocks into which the order is cut, if the caller names none.
BLOCKS = 64


def blocked(df: DataFrame, order: str, blocks: int = BLOCKS, name: str = "__block") -> DataFrame:
    """``df`` with the block each row is in: blocks follow each other in ``order`` and hold about equally many rows of the
    whole table, so those of a key that holds much of it do too.  Nulls are in the first.

    The borders are quantiles, ``blocks`` numbers that are looked up at once; equal places share a block.  Places without a whole-number
    form are compared as doubles."""
    place = whole(df, order)
    place = F.col(order).cast("double") if place is None else place
    marks = df.agg(F.percentile_approx(place, [i / blocks for i in range(1, blocks)], 20 * blocks)).first()[0] or []
    return df.withColumn(name, sum((F.when(place > F.lit(m), 1).otherwise(0) for m in sorted(set(marks))), F.lit(0)))


def blocked_by_position(df: DataFrame, place: str, size: int, name: str = "__block") -> DataFrame:
    """``df`` with blocks of ``size`` consecutive positions."""
    return df.withColumn(name, F.floor(F.col(place) / size).cast("long"))


def _earlier(block: str) -> WindowSpec:
    """All blocks of a key before this one, of which there are few."""
    return Window.partitionBy("__key").orderBy(block).rowsBetween(Window.unboundedPreceding, -1)


def _keyed(df: DataFrame, keys: Sequence[str], value: Column) -> DataFrame:
    """``df`` with its key as one struct, by which null keys meet like others, and the value that is scanned."""
    return df.withColumns({"__key": F.struct(*keys), "__value": value})


def _reach(order: Sequence[str | Column], block: str, before: bool = False) -> WindowSpec:
    return Window.partitionBy("__key", block).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1 if before else Window.currentRow)


def _running(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], value: Column, name: str, block: str) -> DataFrame:
    own = _keyed(df, keys, value)
    totals = own.groupBy("__key", block).agg(F.sum("__value").alias("__total"))
    starts = totals.withColumn("__start", F.coalesce(F.sum("__total").over(_earlier(block)), F.lit(0))).drop("__total")
    within = own.withColumn("__within", F.sum("__value").over(_reach(order, block)))  # rows then lie by key and block, as the join asks
    return within.join(starts, ["__key", block]).withColumn(name, F.col("__within") + F.col("__start")).select(*[c for c in df.columns if c != name], name)


def numbered(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], name: str = "nth", block: str = "__block") -> DataFrame:
    """``df``, which has blocks, with the running number of each row within its key, from 1."""
    return _running(df, keys, order, F.lit(1), name, block).withColumn(name, F.col(name).cast("int"))


def summed(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], value: Column, name: str, block: str = "__block") -> DataFrame:
    """``df``, which has blocks, with the running sum of whole-number ``value`` up to each row of its key; null counts as 0."""
    return _running(df, keys, order, F.coalesce(value.cast("long"), F.lit(0)), name, block)


def carried(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], value: Column, name: str, before: bool = False, block: str = "__block") -> DataFrame:
    """``df``, which has blocks, with the last non-null ``value`` at (or only ``before``) each row of its key."""
    return carried_all(df, keys, order, {name: value}, before, block)


def carried_all(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], values: dict[str, Column], before: bool = False, block: str = "__block") -> DataFrame:
    """``carried`` for several values at once, each by its own name."""
    own = df.withColumn("__key", F.struct(*keys)).withColumns({f"__v_{n}": v for n, v in values.items()})
    place = F.struct(*[(F.col(c) if isinstance(c, str) else c).alias(f"o{i}") for i, c in enumerate(order)])
    last = own.groupBy("__key", block).agg(*[F.max_by(f"__v_{n}", F.when(F.col(f"__v_{n}").isNotNull(), place)).alias(f"__l_{n}") for n in values])
    starts = last.select("__key", block, *[F.last(f"__l_{n}", ignorenulls=True).over(_earlier(block)).alias(f"__s_{n}") for n in values])
    within = own.withColumns({f"__w_{n}": F.last(f"__v_{n}", ignorenulls=True).over(_reach(order, block, before)) for n in values})
    return within.join(starts, ["__key", block]).select(*[c for c in df.columns if c not in values], *[F.coalesce(f"__w_{n}", f"__s_{n}").alias(n) for n in values])


def haloed(df: DataFrame, place: str, size: int, before: int, after: int) -> DataFrame:
    """``df`` with __block, blocks of ``size`` positions, and __own; the ``before`` last and ``after`` first rows of a block
    are in its neighbours too (not __own), so that windows of that width need no other block.  Positions are 1, 2, 3, ..."""
    at = F.floor(F.col(place) / size).cast("long")
    inner = F.pmod(F.col(place), F.lit(size))
    where = F.array(F.struct(at.alias("b"), F.lit(True).alias("own")), F.when(inner < after, F.struct((at - 1).alias("b"), F.lit(False).alias("own"))), F.when(inner >= size - before, F.struct((at + 1).alias("b"), F.lit(False).alias("own"))))
    return df.withColumn("__at", F.explode(F.array_compact(where))).withColumns({"__block": F.col("__at.b"), "__own": F.col("__at.own")}).drop("__at")
