"""Groupings: discriminating values, duplicates, last-wins and best-of keys, blocks, look-back flags."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from atomweave.operators import scan


def duplicates(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, and how often."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def keep_last(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Of each key the last row in ``order``: a keyed overwrite.  It's an aggregate, so tasks reduce before the shuffle."""
    own = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max(F.struct(*[c.alias(f"__o{i}") for i, c in enumerate(order)], F.struct(*own).alias("__row"))).alias("__best"))
    return best.select(*keys, *[F.col(f"__best.__row.`{c}`").alias(c) for c in own])


def discriminating(df: DataFrame, base: str, value: str, place: str, row: Sequence[str], alone: bool = False) -> DataFrame:
    """(row, value): for rows whose base is not unique, their first value that no other row of that base has.

    ``alone``: a row counts even if it's the only one of its base here, as rows without values aren't here."""
    shared = df.groupBy(base).agg(F.count_distinct(*row).alias("__rows")).where("__rows > 1").select(base)
    lone = df.groupBy(base, value).agg(F.count_distinct(*row).alias("__n")).where("__n = 1").select(base, value)
    return (df if alone else df.join(shared, base, "left_semi")).join(lone, [base, value], "left_semi").groupBy(*row).agg(F.min_by(value, F.struct(place, value)).alias(value))


def _near(df: DataFrame, keys: Sequence[str], order: Sequence[str], before: int, after: int, size: int | None, value: Column, name: str) -> DataFrame:
    """``df`` with ``value`` over a window of some rows before and after.  With ``size`` the order is a position 1, 2, 3, ...
    and a key is cut into blocks of so many, each with what it needs of its neighbours."""
    whole = df if size is None else scan.haloed(df, order[0], size, max(-before, 0), max(after, 0))
    w = Window.partitionBy(*keys, *([] if size is None else ["__block"])).orderBy(*order).rowsBetween(before, after)
    out = whole.withColumn(name, value.over(w))
    return out if size is None else out.where("__own").drop("__own", "__block")


def flagged_before(df: DataFrame, keys: Sequence[str], order: Sequence[str], flag: Column, width: int, name: str, size: int | None = None) -> DataFrame:
    """``df`` with the nearest decided (non-null) flag of the ``width`` rows before each; ``size``: see ``_near``."""
    return _near(df, keys, order, -width, -1, size, F.last(flag, ignorenulls=True), name)


def following(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, width: int, name: str, size: int | None = None) -> DataFrame:
    """``df`` with the values of this and the next ``width - 1`` rows as an array in order; ``size``: see ``_near``."""
    return _near(df, keys, order, 0, width - 1, size, F.collect_list(value), name)


def blocks(df: DataFrame, keys: Sequence[str], order: Sequence[str], opens: Column, name: str = "block", size: int | None = None) -> DataFrame:
    """``df`` with the number of the block each row is in; a row for which ``opens`` holds begins a new one.  With ``size``
    the order is a position, and a key is worked on in pieces of so many."""
    if size is not None:
        return scan.summed(scan.blocked_by_position(df, order[0], size), keys, order, opens.cast("int"), name).drop("__block")
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn(name, F.sum(F.when(opens, 1).otherwise(0)).over(w).cast("long"))


def lines(df: DataFrame, keys: Sequence[str], text: str) -> DataFrame:
    """(keys, pos, line): the lines of a text, from 1; one last empty line doesn't count, nor do carriage returns at line ends."""
    bare = F.regexp_replace(F.col(text), r"\r?\n\z", "")
    return df.select(*keys, F.posexplode(F.split(bare, r"\r?\n")).alias("pos", "line")).withColumn("pos", F.col("pos").cast("long") + 1)
