"""The nearest value is found by looking at neighbours in order, not by comparing all that are near enough."""

import random

from pyspark.sql import functions as F

from atomweave.operators import joins


def test_nearest_equals_comparing_all(spark):
    rng = random.Random(23)
    value = lambda: rng.choice([round(rng.uniform(-40, 40), 1), rng.randint(-3, 3) * 5.0, 0.0, -0.0])
    left = [(i, rng.choice(["a", "b", None]), value()) for i in range(300)] + [(900, "a", None), (901, "a", float("nan")), (902, "b", float("inf")), (3, "a", 7.0), (903, "c", 1e300)]
    right = [(i, rng.choice(["a", "b", None]), value(), f"n{i % 9}") for i in range(60)] + [(90, "a", None, "a"), (91, "b", float("nan"), "a"), (92, "a", float("-inf"), "a"), (93, "c", 1e300, "a")]
    l, r = spark.createDataFrame(left, "i long, k string, x double"), spark.createDataFrame(right, "j long, k string, y double, name string")
    for tolerance in (5.0, 0.3, 0.0, 200.0):
        got = joins.nearest_within(l, r, ["k"], "x", "y", tolerance, ["i"], "name").select("i", "distance", "name", "j").collect()
        best = {}
        for i, k, x in left:
            for j, m, y, name in right:
                if k is not None and k == m and x is not None and y is not None and abs(x - y) <= tolerance:
                    best[i] = min(best.get(i, (float("inf"),)), (abs(x - y), name, j))
        if tolerance:
            assert sorted((x["i"], (x["distance"], x["name"], x["j"])) for x in got) == sorted(best.items())
        else:
            assert {x["i"]: x["j"] for x in got} == {i: v[2] for i, v in best.items()}


def test_no_rows_for_all_that_are_near(spark):
    """All of 2,000 values are within the tolerance of all of 2,000 others: no join makes these pairs."""
    l = spark.range(2000).select("id", F.lit("k").alias("k"), (F.col("id") * 7919 % 2003).cast("double").alias("x"))
    r = spark.range(2000).select(F.col("id").alias("j"), F.lit("k").alias("k"), (F.col("id") * 104729 % 2011 + 0.25).alias("y"), F.col("id").cast("string").alias("name"))
    out = joins.nearest_within(l, r, ["k"], "x", "y", 5000.0, ["id"], "name")
    assert out.count() == 2000 and out.where("distance > 10").isEmpty()
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" in plan and "floor" in plan.lower() and "sequence" not in plan.lower()
