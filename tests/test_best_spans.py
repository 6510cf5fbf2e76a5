"""The best span of each point is found without making all pairs that hold."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from atomweave.operators import joins, ranges


@pytest.fixture
def crowd(spark):
    """A key of 400 spans, most of them around most points, one of a few, null keys, spans that end before they begin."""
    rng = random.Random(17)
    spans = [("hot", (a := rng.randint(-400, 300)), a + rng.choice([-1, 0, 1, 7, 500, 500, 900]), f"s{n % 90}") for n in range(400)]
    spans += [("few", (a := rng.randint(0, 50)), a + rng.choice([0, 5, 30]), f"t{n}") for n in range(20)] + [(None, 0, 90, "n")] * 70 + [("hot", None, 5, "x"), ("hot", 5, None, "y")]
    points = [(rng.choice(["hot", "hot", "few"]), rng.randint(-450, 950), n) for n in range(300)] + [(None, 3, 900), ("hot", None, 901), ("none", 3, 902), ("hot", 40, 903), ("hot", 40, 903)]
    return spans, points, spark.createDataFrame(spans, "k string, a long, b long, name string"), spark.createDataFrame(points, "k string, x long, n long")


def around(spans, k, x):
    return [(a, b, name) for j, a, b, name in spans if None not in (k, x, a, b) and j == k and a <= x <= b]


def test_innermost_of_a_crowded_key(crowd):
    spans, points, s, p = crowd
    got = joins.innermost(p, s, ["k"], "x", "a", "b").select("k", "x", "n", "a", "b", "name").collect()
    want = [(k, x, n, *min(held, key=lambda v: (v[1] - v[0], v))) for k, x, n in points if (held := around(spans, k, x))]
    assert sorted(map(tuple, got)) == sorted(want)


def test_pairs_do_not_grow_with_the_spans_that_hold(crowd):
    _, points, s, p = crowd
    hot = p.where("k = 'hot'")
    order = [F.col("b") - F.col("a"), F.col("a"), F.col("name")]
    pairs = ranges.candidates(hot, s, ["k"], "x", "a", "b", order)
    pairs.write.format("noop").mode("overwrite").save()
    assert pairs.count() <= 11 * hot.count() < ranges.inside(hot, s, ["k"], "x", "a", "b").count() / 4


def test_times_of_keys_with_few_spans_are_not_cut(spark):
    """Ten spans of a month for each key, in microseconds: no row is made for each of some forty levels."""
    day = lambda n: dt.datetime(1996, 1, 1) + dt.timedelta(days=n)
    spans = spark.createDataFrame([(i % 20, day(i * 7 % 300), day(i * 7 % 300 + 30), i) for i in range(200)], "k long, a timestamp_ntz, b timestamp_ntz, s long")
    points = spark.createDataFrame([(i % 20, day(i * 11 % 350), i) for i in range(400)], "k long, at timestamp_ntz, n long")
    out = joins.exact_then_interval(points, spans, ["k"], "at", "a", "b", ["n"])
    assert "__level" not in out._jdf.queryExecution().optimizedPlan().toString()
    held = points.join(spans, "k").where("at BETWEEN a AND b").groupBy("n").agg(F.max(F.struct("a", "s"))["s"].alias("s"))
    want = points.join(held, "n", "left").select("n", "s").collect()
    assert sorted(map(tuple, out.select("n", "s").collect())) == sorted(map(tuple, want))


def test_latest_span_of_a_crowded_key(crowd):
    spans, points, s, p = crowd
    got = joins.exact_then_interval(p.distinct(), s, ["k"], "x", "a", "b", ["n"]).select("k", "x", "n", "a", "b", "name", "exact").collect()
    best = lambda k, x: max(((a == x, a, b, name) for a, b, name in around(spans, k, x)), default=None)
    want = [(k, x, n, *((v[1], v[2], v[3], v[0]) if (v := best(k, x)) else (None,) * 4)) for k, x, n in set(points)]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
