"""Joins that SQL has no word for: by position, by look-back band, as of, by innermost interval, by nearest value."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from atomweave.operators import ranges, scan


def numbered(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], name: str = "nth", blocks: int | None = None) -> DataFrame:
    """``df`` with the running number of each row within its key; with ``blocks``, keys of any size are cut along the
    first column of the order."""
    if blocks and isinstance(order[0], str):
        return scan.numbered(scan.blocked(df, order[0], blocks), keys, order, name).drop("__block")
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def nth_zip(left: DataFrame, right: DataFrame, keys: Sequence[str], left_order: Sequence[str | Column], right_order: Sequence[str | Column], how: str = "inner", blocks: int | None = None) -> DataFrame:
    """The n-th left row of a key with its n-th right row; both sides share one partitioning by key, or with ``blocks`` by
    key and number."""
    return numbered(left, keys, left_order, blocks=blocks).join(numbered(right, keys, right_order, blocks=blocks), [*keys, "nth"], how)


def lookback(points: DataFrame, refs: DataFrame, keys: Sequence[str], point: str, ref: str, width: int) -> DataFrame:
    """Points with the refs 0 to ``width`` places before them, and how far before (``offset``).

    A point asks for the width + 1 places by name, so it's an equi-join, however long a key's sequence is."""
    asked = points.withColumn("__at", F.explode(F.sequence(F.col(point) - width, F.col(point))))
    return asked.join(refs.withColumn("__at", F.col(ref)), [*keys, "__at"]).withColumn("offset", F.col(point) - F.col("__at")).drop("__at")


def carry_forward(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], value: Column, name: str, blocks: int | None = None) -> DataFrame:
    """``df`` with the last non-null ``value`` at or before each row: what it belongs to.  ``blocks`` as for ``numbered``."""
    if blocks and isinstance(order[0], str):
        return scan.carried(scan.blocked(df, order[0], blocks), keys, order, value, name).drop("__block")
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn(name, F.last(value, ignorenulls=True).over(w))


def asof_backward(points: DataFrame, starts: DataFrame, keys: Sequence[str], point: str, start: str, value: Sequence[str], how: str = "left", blocks: int | None = None) -> DataFrame:
    """Each point with the values of the greatest start at or before it: both sides in one order, values carried forward.

    No pair of a point and a start is made.  ``starts`` must have one row for each key and start."""
    held = F.struct(F.col(start).alias("__start_at"), *value)
    both = points.withColumns({"__at": F.col(point), "__held": F.lit(None), "__kind": F.lit(1)}).unionByName(
        starts.select(*keys, F.col(start).alias("__at"), held.alias("__held"), F.lit(0).alias("__kind")), allowMissingColumns=True
    )
    out = carry_forward(both, keys, ["__at", "__kind"], F.col("__held"), "__last_held", blocks).where("__kind = 1")
    out = out.select(*points.columns, F.col("__last_held.__start_at").alias(start), *[F.col(f"__last_held.{v}").alias(v) for v in value])
    return out if how == "left" else out.where(F.col(start).isNotNull())


def innermost(points: DataFrame, spans: DataFrame, keys: Sequence[str], point: str, first: str, last: str) -> DataFrame:
    """Each point with the shortest span of its key that contains it (then the one that starts first); points in none go.
    Equal points are worked on once and answered each."""
    own, plain = [c for c in spans.columns if c not in keys], points.columns
    points = points.groupBy(*plain).agg(F.count("*").alias("__times"))
    best = F.min(F.struct((F.col(last) - F.col(first)).alias("__len"), F.col(first).alias("__first"), F.struct(*own).alias("__own"))).alias("__best")
    order = [F.col(last) - F.col(first), F.col(first), F.struct(*own)]
    out = ranges.candidates(points, spans, keys, point, first, last, order).groupBy(*plain, "__times").agg(best).withColumn("__nth", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__times"))))
    return out.select(*plain, *[F.col(f"__best.__own.`{c}`").alias(c) for c in own])


def exact_then_interval(left: DataFrame, spans: DataFrame, keys: Sequence[str], point: str, first: str, last: str, row: Sequence[str]) -> DataFrame:
    """Each left row (told apart by ``row``) with the span that starts at its point, else the latest one around it."""
    own = [c for c in spans.columns if c not in keys]
    order = [F.col(first).desc(), F.struct(*[F.col(c) for c in own if c != first]).desc()]
    joined = ranges.candidates(left, spans, keys, point, first, last, order)
    best = joined.groupBy(*row).agg(F.max(F.struct((F.col(point) == F.col(first)).alias("exact"), *[F.col(c) for c in [first, *[c for c in own if c != first]]])).alias("__s"))
    return left.join(best.select(*row, "__s"), list(row), "left").select(*left.columns, *[F.col(f"__s.`{c}`").alias(c) for c in own], F.col("__s.exact").alias("exact"))


def nearest_within(left: DataFrame, right: DataFrame, keys: Sequence[str], left_value: str, right_value: str, tolerance: float, row: Sequence[str], tie: str, span: tuple[str, str] | None = None, also: Column | None = None) -> DataFrame:
    """Each left row with the right row of its key whose value is nearest and at most ``tolerance`` away (or inside the
    left row's ``span``); equal distances go to the least ``tie``.  ``also``: what else must hold of both rows.

    Without a span and ``also``, the nearest values are looked up in one order, see ``_nearest``.  Else values are cut into
    bands as wide as the tolerance, so only neighbouring bands meet; a span and its tolerance are cut into dyadic cells, and
    a right row asks for those that it lies in."""
    own = [c for c in right.columns if c not in keys]
    distance = F.abs(F.col(left_value) - F.col(right_value))
    near = distance <= tolerance
    if span is None and also is None:
        return _nearest(left, right, keys, left_value, right_value, tolerance, row, tie)
    if span is None:
        width = max(tolerance, 1e-9)
        asked = left.withColumn("__b", F.explode(F.sequence(F.floor((F.col(left_value) - tolerance) / width), F.floor((F.col(left_value) + tolerance) / width))))
        met = asked.join(right.withColumn("__b", F.floor(F.col(right_value) / width)), [*keys, "__b"])
    else:
        reach = int(tolerance)
        around = left.withColumns({"__low": F.least(F.col(left_value) - reach, F.col(span[0])), "__high": F.greatest(F.col(left_value) + reach, F.col(span[1]))})
        met = ranges.inside(right, around, keys, right_value, "__low", "__high")
        near = near | F.col(right_value).between(F.col(span[0]), F.col(span[1]))
    if also is not None:
        near = near & also
    best = met.where(near).groupBy(*row).agg(F.min(F.struct(distance.alias("distance"), F.col(tie).alias("__tie"), F.struct(*own).alias("__own"))).alias("__m"))
    return best.select(*row, F.col("__m.distance").alias("distance"), *[F.col(f"__m.__own.`{c}`").alias(c) for c in own])


def _nearest(left: DataFrame, right: DataFrame, keys: Sequence[str], left_value: str, right_value: str, tolerance: float, row: Sequence[str], tie: str) -> DataFrame:
    """``nearest_within`` without pairs: of equal right values the least ``tie`` stays, both sides lie in one order within
    bands as wide as the tolerance, and each left row sees the right values next to it, or at the near ends of the bands
    beside its own."""
    own, width = [c for c in right.columns if c not in keys], max(tolerance, 1e-9)
    band = lambda c: F.greatest(F.least(F.floor(F.col(c) / width), F.lit(2**62)), F.lit(-(2**62)))
    known = right.where(F.abs(F.col(right_value).cast("double")) < float("inf")).dropna(subset=list(keys))
    known = known.groupBy(*keys, F.col(right_value).alias("__at")).agg(F.min(F.struct(F.col(tie).alias("__tie"), F.struct(*own).alias("__own"))).alias("__r")).withColumn("__band", band("__at"))
    # the ends of the bands one and two below and above (two, as distances are rounded)
    ends = known.groupBy(*keys, "__band").agg(F.min_by("__r", "__at").alias("__first"), F.max_by("__r", "__at").alias("__last")).withColumn("__by", F.explode(F.array(*[F.lit(n) for n in (-2, -1, 1, 2)])))
    side = lambda best, c, above: best(F.when((F.col("__by") < 0) == F.lit(above), F.col(c)), F.when((F.col("__by") < 0) == F.lit(above), F.abs("__by")))
    ends = ends.withColumn("__band", F.col("__band") + F.col("__by")).groupBy(*keys, "__band").agg(side(F.min_by, "__last", False).alias("__below"), side(F.min_by, "__first", True).alias("__above"))
    both = left.withColumns({"__at": F.col(left_value), "__band": band(left_value), "__kind": F.lit(1)}).unionByName(known.withColumn("__kind", F.lit(0)), allowMissingColumns=True)
    within = Window.partitionBy(*keys, "__band").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = both.withColumn("__under", F.last("__r", ignorenulls=True).over(within.orderBy("__at", "__kind"))).withColumn("__over", F.last("__r", ignorenulls=True).over(within.orderBy(F.col("__at").desc(), "__kind")))
    met = both.where("__kind = 1").join(ends, [*keys, "__band"], "left")

    def choice(c: str) -> Column:
        distance = F.abs(F.col(left_value) - F.col(f"{c}.__own.`{right_value}`"))
        return F.when(distance <= tolerance, F.struct(distance.alias("distance"), F.col(f"{c}.__tie"), F.col(f"{c}.__own")))

    met = met.withColumn("__m", F.least(*[choice(c) for c in ("__under", "__over", "__below", "__above")])).where("__m IS NOT NULL")
    best = met.groupBy(*row).agg(F.min("__m").alias("__m"))
    return best.select(*row, F.col("__m.distance").alias("distance"), *[F.col(f"__m.__own.`{c}`").alias(c) for c in own])


def resolve(calls: DataFrame, call: Sequence[str], accepted: Column) -> DataFrame:
    """Candidates of each call: the accepted one if there's exactly one, else all.  Counting is by call, in one window."""
    w = Window.partitionBy(*call)
    return calls.withColumn("__ok", F.coalesce(accepted, F.lit(False))).withColumn("__n", F.count_if("__ok").over(w)).where((F.col("__n") != 1) | F.col("__ok")).drop("__ok", "__n")


def contained(texts: DataFrame, key: str, text: str, needles: DataFrame, needle_key: str, needle: str) -> DataFrame:
    """(key, needle_key) of texts that hold a needle literally; empty needles are in none.

    Texts and needles meet by a seed: of the words inside a needle, which the text then has as words, the one that fewest
    texts have; of needles without one, the rarest run of letters of a part, which stands inside some word of the text.
    Whole texts are looked at only where a seed is met, and a needle with a seed that no text has nowhere."""
    space = r"[ \t\n\x0B\f\r]+"
    parts = F.split("__needle", space)
    longest = F.aggregate(parts, F.lit(""), lambda x, y: F.when(F.length(y) > F.length(x), y).otherwise(x))
    inner = F.filter(F.slice(parts, 2, F.greatest(F.size(parts) - 2, F.lit(0))), lambda w: w != "")
    seeded = needles.where(F.length(needle) > 0).select(F.col(needle_key), F.col(needle).alias("__needle")).withColumns({"__inner": inner, "__long": longest})
    words = texts.select(F.col(key).alias("__key"), F.explode(F.array_distinct(F.split(text, space))).alias("seed"))
    whole = seeded.where(F.size("__inner") > 0).select(needle_key, F.explode(F.array_distinct("__inner")).alias("seed"))
    hits = _by_rarest(words, whole, needle_key)
    short = seeded.where(F.size("__inner") == 0).select(needle_key, F.explode(_runs(F.col("__long"), F.least(F.length("__long"), F.lit(3)))).alias("seed")).distinct()
    if not short.isEmpty():
        hits = hits.unionByName(_by_rarest(words.select("__key", F.explode(_grams(F.col("seed"))).alias("seed")), short, needle_key))
    met = texts.select(F.col(key).alias("__own"), F.col(text).alias("__text")).join(hits.distinct(), F.col("__own").eqNullSafe(F.col("__key")))
    return met.join(seeded.select(F.col(needle_key).alias("__named"), "__needle"), F.col(needle_key).eqNullSafe(F.col("__named"))).where(F.contains("__text", F.col("__needle"))).select(F.col("__own").alias(key), needle_key)


def _by_rarest(held: DataFrame, seeds: DataFrame, needle_key: str) -> DataFrame:
    """(__key, needle_key): texts (__key, seed) that have the seed of a needle (needle_key, seed) which fewest have."""
    often = held.join(seeds.select("seed").distinct(), "seed", "left_semi").groupBy("seed").agg(F.count("*").alias("__n"))
    best = seeds.join(often, "seed").groupBy(needle_key).agg(F.min(F.struct("__n", "seed"))["seed"].alias("seed"))
    return held.join(best, "seed").select("__key", needle_key)


def _runs(word: Column, n: Column) -> Column:
    """The runs of ``n`` letters of a word."""
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(word) - n + 1, F.lit(1))), lambda i: F.substr(word, i, n)))


def _grams(word: Column) -> Column:
    """The distinct runs of up to three letters of a word, the empty one included."""
    return F.array_distinct(F.concat(F.array(F.lit("")), *[_runs(word, F.lit(n)) for n in (1, 2, 3)]))
