"""Points in spans by dyadic cells: an equi-join that makes no pair of a point and a span that doesn't hold it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from atomweave.operators.cut import cut

#: Spans of a key that each of its points is simply held against; keys of more are cut into cells.
FEW_SPANS = 64
#: Cells of a level are 2 ** level wide; wider ones aren't needed for 64-bit places.
LEVELS = 61


def whole(df: DataFrame, name: str) -> Column | None:
    """A column as whole numbers in the same order (times in microseconds, dates in days), or None if its type has no such."""
    kind = df.schema[name].dataType.typeName()
    if kind in ("byte", "short", "integer", "long"):
        return F.col(name).cast("long")
    if kind == "date":
        return F.unix_date(name).cast("long")
    if kind == "timestamp":
        return F.unix_micros(name)
    return F.unix_micros(F.col(name).cast("timestamp")) if kind == "timestamp_ntz" else None


def cells(first: Column, last: Column) -> Column:
    """The fewest dyadic cells (level, cell) that make up the span from ``first`` to ``last``: at most two of a level.

    Of a level, those inside the span stand side by side; only the outermost two can lie in a parent that sticks out."""
    top = F.least(F.ceil(F.log2(F.greatest(last - first, F.lit(0).cast("long")).cast("double") + 2)).cast("int"), F.lit(LEVELS))
    return F.when(first <= last, F.flatten(F.transform(F.sequence(F.lit(0), top), lambda level: _outermost(first, last, level))))


def _outermost(first: Column, last: Column, level: Column) -> Column:
    one = F.lit(1).cast("long")
    wide = lambda n: F.call_function("shiftleft", one, n)
    down = lambda x, n: F.call_function("shiftright", x, n)
    low = lambda n: down(first + wide(n) - 1, n)
    high = lambda n: down(last + 1, n) - 1
    up = level + 1
    inner = F.filter(F.array_distinct(F.array(low(level), high(level))), lambda c: (low(level) <= high(level)) & ~down(c, F.lit(1)).between(low(up), high(up)))
    return F.transform(inner, lambda c: F.struct(level.alias("level"), c.alias("cell")))


def inside(points: DataFrame, spans: DataFrame, keys: Sequence[str], point: str, first: str, last: str) -> DataFrame:
    """Points joined with the spans of their key that hold them, the span's ends included.

    A span is cut into cells, a point asks for the cell that it lies in on each level that spans have, so a key of many
    spans and points is spread over as many tasks as it has cells.  Places that aren't whole numbers meet by key alone."""
    at, a, b = whole(points, point), whole(spans, first), whole(spans, last)
    if at is None or a is None or b is None:
        return points.join(spans, list(keys)).where(F.col(point).between(F.col(first), F.col(last)))
    cut = spans.withColumn("__cell", F.explode(cells(a, b))).withColumns({"__level": F.col("__cell.level"), "__cell": F.col("__cell.cell")})
    used = cut.agg(F.array_sort(F.collect_set("__level"))).scalar()
    asked = points.withColumn("__level", F.explode(used)).withColumn("__cell", F.call_function("shiftright", at, F.col("__level")))
    return asked.join(cut, [*keys, "__level", "__cell"]).drop("__level", "__cell")


def candidates(points: DataFrame, spans: DataFrame, keys: Sequence[str], point: str, first: str, last: str, order: Sequence[Column]) -> DataFrame:
    """Of the pairs of ``inside`` some for each point, among them that with the span which comes first in ``order``.

    Points of a key of up to FEW_SPANS spans meet all that hold them.  Spans of other keys are numbered in ``order`` and cut
    into cells, of which each keeps the least number only; so a point meets one span of a level at most, and rows grow with
    points and spans, not with the pairs that hold."""
    at, a, b = whole(points, point), whole(spans, first), whole(spans, last)
    if at is None or a is None or b is None:
        return inside(points, spans, keys, point, first, last)
    held = F.col(point).between(F.col(first), F.col(last))
    crowded = cut(spans.groupBy(*keys).agg(F.count("*").alias("__n")).where(F.col("__n") > FEW_SPANS).select(*keys, F.lit(True).alias("__crowded")))
    if crowded.isEmpty():
        return points.join(spans, list(keys)).where(held)
    listed = cut(spans.join(crowded, list(keys), "left_semi").where(a <= b).orderBy(*order).withColumn("__nth", F.monotonically_increasing_id()))
    top = F.ceil(F.log2((b - a).cast("double") + 2)).cast("int")
    levels = listed.agg(F.max(F.least(top, F.lit(LEVELS))).alias("top")).select(F.sequence(F.lit(0), F.coalesce("top", F.lit(0)))).scalar()
    best = _maximal(listed.select(*keys, "__nth", a.alias("__a"), b.alias("__b"), F.explode(F.sequence(F.lit(0), F.least(top, F.lit(LEVELS)))).alias("__level")))
    best = best.groupBy(*keys, "__level", "__cell").agg(F.min("__nth").alias("__nth"))
    best = best.join(listed.drop(*keys), "__nth").drop("__nth")
    few = spans.join(crowded, list(keys), "left_anti").withColumns({"__level": F.lit(-1), "__cell": F.lit(0).cast("long")})
    asked = points.join(crowded, list(keys), "left").withColumn("__level", F.explode(F.when(F.col("__crowded"), levels).otherwise(F.array(F.lit(-1))))).drop("__crowded")
    asked = asked.withColumn("__cell", F.when(F.col("__level") >= 0, F.call_function("shiftright", at, F.col("__level"))).otherwise(F.lit(0).cast("long")))
    return asked.join(best.unionByName(few), [*keys, "__level", "__cell"]).where(held).drop("__level", "__cell")


def _maximal(df: DataFrame) -> DataFrame:
    """``df`` (__a, __b, __level, ...) with the cells of that level that ``cells`` names, in __cell: the outermost two that lie
    inside, unless with its neighbour inside as well it makes up a cell of the next level."""
    one = F.lit(1).cast("long")
    wide = F.call_function("shiftleft", one, F.col("__level"))
    df = df.withColumns({"__low": F.call_function("shiftright", F.col("__a") + wide - 1, F.col("__level")), "__high": F.call_function("shiftright", F.col("__b") + 1, F.col("__level")) - 1}).where("__low <= __high")
    same = F.col("__low") == F.col("__high")
    low = F.when(same | (F.col("__low").bitwiseAND(one) == 1), F.col("__low"))
    high = F.when(~same & (F.col("__high").bitwiseAND(one) == 0), F.col("__high"))
    return df.withColumn("__cell", F.explode(F.array(low, high))).where("__cell IS NOT NULL").drop("__a", "__b", "__low", "__high")
