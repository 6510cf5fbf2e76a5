"""Joins and scans on hot keys: the same rows as plain versions, and work that is spread over tasks."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from atomweave.functions import paths
from atomweave.operators import grouping, joins, ranges, scan


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


@pytest.fixture(scope="module")
def events(spark):
    """Half of all rows have one key; null keys, null places and ties are there."""
    rng = random.Random(3)
    data = [("hot" if i % 2 else rng.choice(["a", "b", None]), rng.choice([None, *range(-50, 900)]), i, rng.choice([None, None, f"v{i}"])) for i in range(3000)]
    return spark.createDataFrame(data, "k string, t long, i long, v string").repartition(7)


@pytest.mark.parametrize("blocks", [2, 16, 64])
def test_blocked_scans_equal_windows(events, blocks):
    w = Window.partitionBy("k").orderBy("t", "i")
    plain = events.withColumns({"nth": F.row_number().over(w), "last": F.last("v", True).over(w.rowsBetween(Window.unboundedPreceding, 0)), "before": F.last("v", True).over(w.rowsBetween(Window.unboundedPreceding, -1)), "total": F.sum(F.col("i") % 7).over(w.rowsBetween(Window.unboundedPreceding, 0))})
    cut = scan.blocked(events, "t", blocks)
    assert rows(joins.numbered(events, ["k"], ["t", "i"], blocks=blocks), "i", "nth") == rows(plain, "i", "nth")
    assert rows(joins.carry_forward(events, ["k"], ["t", "i"], F.col("v"), "last", blocks), "i", "last") == rows(plain, "i", "last")
    assert rows(scan.carried(cut, ["k"], ["t", "i"], F.col("v"), "before", before=True), "i", "before") == rows(plain, "i", "before")
    assert rows(scan.summed(cut, ["k"], ["t", "i"], F.col("i") % 7, "total"), "i", "total") == rows(plain, "i", "total")


def test_a_hot_key_is_spread_over_blocks(spark):
    """A key of half the table has blocks of about equal size, none over twice the median."""
    df = spark.range(40_000).select(F.when(F.col("id") % 2 == 0, 0).otherwise(F.col("id") % 97).alias("k"), (F.col("id") * 7919 % 40_009).alias("t"), "id")
    sizes = sorted(r["n"] for r in scan.blocked(df, "t", 32).where("k = 0").groupBy("__block").agg(F.count("*").alias("n")).collect())
    assert len(sizes) == 32 and sizes[-1] <= 2 * sizes[16]
    plan = joins.carry_forward(df, ["k"], ["t"], F.when(F.col("id") % 50 == 0, F.col("id")), "c", 32)._jdf.queryExecution().executedPlan().toString()
    assert "__block" in plan


def test_scans_of_empty_tables(spark, events):
    none = events.where("i < 0")
    assert joins.numbered(none, ["k"], ["t"], blocks=8).collect() == [] and joins.carry_forward(none, ["k"], ["t"], F.col("v"), "c", 8).collect() == []


def test_points_meet_spans_by_cells(spark):
    rng = random.Random(5)
    spans = [(rng.choice("ab"), (a := rng.randint(-(2**40), 2**40) if n % 9 == 0 else rng.randint(-3000, 3000)), a + rng.choice([-1, 0, 1, 6, 100, 4000, 10**6]), n) for n in range(400)] + [("a", None, 5, 900), ("a", 5, None, 901), (None, 0, 9, 902), ("b", -(2**60), 2**60, 903)]
    points = [(rng.choice("ab"), rng.randint(-3500, 7500), n) for n in range(300)] + [("a", None, 901), (None, 3, 902)]
    met = ranges.inside(spark.createDataFrame(points, "k string, x long, p long"), spark.createDataFrame(spans, "k string, a long, b long, s long"), ["k"], "x", "a", "b")
    want = [(p, s) for k, x, p in points for j, a, b, s in spans if k is not None and k == j and None not in (x, a, b) and a <= x <= b]
    assert rows(met, "p", "s") == sorted(want, key=str)


def test_no_pair_lies_outside_a_cell(spark):
    """Spans of 1 to a million lines of one hot key: the join makes exactly the pairs that hold."""
    spans = spark.range(2000).select(F.lit("new").alias("k"), (F.col("id") * 499).alias("a"), (F.col("id") * 499 + F.pow(F.lit(10.0), F.col("id") % 7).cast("long") - 1).alias("b"), "id")
    points = spark.range(3000).select(F.lit("new").alias("k"), (F.col("id") * 331).alias("x"), F.col("id").alias("p"))
    joined = ranges.inside(points, spans, ["k"], "x", "a", "b")
    joined.write.format("noop").mode("overwrite").save()
    n = joined.count()
    assert n == points.join(spans, "k").where("x between a and b").count()
    # of one span no two cells overlap, and there are at most two of a level
    cut = spans.select("a", "b", F.explode(ranges.cells(F.col("a"), F.col("b"))).alias("c"))
    width = F.sum(F.expr("shiftleft(1L, c.level)"))
    assert cut.groupBy("a", "b").agg(width.alias("w")).where("w <> b - a + 1").isEmpty() and cut.groupBy("a", "b", "c.level").count().where("count > 2").isEmpty()


def test_innermost_and_exact_then_interval(spark):
    rng = random.Random(7)
    spans = [("f", (a := rng.randint(0, 500)), a + rng.choice([0, 3, 50, 400]), f"s{n}") for n in range(60)]
    points = [("f", rng.randint(-5, 950), n) for n in range(200)] + [("f", 7, 3)]
    s, p = spark.createDataFrame(spans, "k string, a int, b int, name string"), spark.createDataFrame(points, "k string, x long, n long")
    best = {(x, n): min(((b - a, a, name) for _, a, b, name in spans if a <= x <= b), default=None) for _, x, n in points}
    got = joins.innermost(p, s, ["k"], "x", "a", "b").select("x", "n", "name").collect()
    assert sorted(map(tuple, got)) == sorted((x, n, b[2]) for _, x, n in points if (b := best[x, n]))
    late = {n: max(((a == x, a, b, name) for _, a, b, name in spans if a <= x <= b), default=None) for _, x, n in points[:-1]}
    got = joins.exact_then_interval(spark.createDataFrame(points[:-1], "k string, x long, n long"), s, ["k"], "x", "a", "b", ["n"]).select("n", "a", "name", "exact").collect()
    assert {r["n"]: tuple(r)[1:] for r in got} == {n: (v[1], v[3], v[0]) if v else (None, None, None) for n, v in late.items()}


def test_paths_match_as_by_comparing_all(spark):
    rng = random.Random(11)
    part = lambda: rng.choice(["src", "a", "b", "mod", "lib", "x y", "é"])
    make = lambda: "/" * rng.randint(0, 1) + "/".join(part() for _ in range(rng.randint(0, 4))) + rng.choice(["/", ""]) + rng.choice(["mod.rs", "lib.rs", "mylib.rs", "b.rs"])
    left, right = [(i, make()) for i in range(150)] + [(900, ""), (901, None), (902, "a/")], sorted({make() for _ in range(60)}) + ["", None]

    def score(a, b):
        if not a or not b:
            return 0
        return 3 if a == b else 2 if a.endswith(b) or b.endswith(a) else 1 if a.rsplit("/", 1)[-1] == b.rsplit("/", 1)[-1] != "" else 0

    want = {i: max(((score(a, b), b) for b in right if score(a, b)), key=lambda x: (x[0], [-ord(c) for c in x[1]] + [1]), default=None) for i, a in left}
    l, r = spark.createDataFrame(left, "i long, path string"), spark.createDataFrame([(x,) for x in right], "own string")
    got = {x["i"]: (x["score"], x["own"]) for x in paths.best_match(l, r, "i", "path", "own").collect()}
    assert {i: v[0] for i, v in got.items()} == {i: v[0] for i, v in want.items() if v}
    assert all(v[1] == min(b for b in right if score(dict(left)[i], b) == v[0]) for i, v in got.items())
    inner = lambda p: p[p.index("/src/") + 1 :] if "/src/" in p else p
    pairs = {(a, b) for _, a in left for b in right if a and b and (score(a, b) >= 2 or inner(a) == inner(b))}
    assert {tuple(x) for x in paths.matching(l, r, "path", "own").collect()} == pairs


def test_one_file_name_in_all_paths_makes_no_pairs(spark):
    """4,000 folders with a mod.rs: rows grow with the paths, not with their square."""
    l = spark.range(4000).select(F.col("id").alias("i"), F.concat(F.lit("p/src/d"), F.col("id").cast("string"), F.lit("/mod.rs")).alias("path"))
    r = spark.range(4000).select(F.concat(F.lit("src/d"), F.col("id").cast("string"), F.lit("/mod.rs")).alias("own"))
    best = paths.best_match(l, r, "i", "path", "own")
    assert best.where("score = 2").count() == 4000
    assert paths.matching(l, r, "path", "own").count() == 4000


@pytest.mark.parametrize("size", [20, 64])
def test_haloed_windows_equal_whole_ones(spark, size):
    rng = random.Random(13)
    lines = spark.createDataFrame([("one", n, f"l{n}", rng.choice([None, None, None, True, False])) for n in range(1, 400)] + [("two", n, f"m{n}", None) for n in range(1, 7)], "log string, pos long, line string, flag boolean").repartition(5)
    for width in (1, 10, 16):
        a, b = (grouping.flagged_before(lines, ["log"], ["pos"], F.col("flag"), width, "x", s) for s in (None, size))
        assert rows(a, "log", "pos", "x") == rows(b, "log", "pos", "x")
        a, b = (grouping.following(lines, ["log"], ["pos"], "line", width, "x", s) for s in (None, size))
        assert rows(a, "log", "pos", "x") == rows(b, "log", "pos", "x")
    a, b = (grouping.blocks(lines, ["log"], ["pos"], F.coalesce("flag", F.lit(False)), size=s) for s in (None, size))
    assert rows(a, "log", "pos", "block") == rows(b, "log", "pos", "block")


def test_chains_are_reached_in_few_rounds(spark, monkeypatch):
    """A chain of 10,000 takes 40 rounds at most; cycles, hubs and side branches are right."""
    from atomweave.operators import closure

    jobs = [0]
    plain = closure.cut
    monkeypatch.setattr(closure, "cut", lambda df: (jobs.__setitem__(0, jobs[0] + 1), plain(df))[1])
    n = 10_000
    chain = spark.range(n).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    assert closure.reachable(spark.createDataFrame([(17,)], "id long"), chain).count() == n + 1 - 17
    assert jobs[0] <= 45  # rounds, and a table now and then
    rng = random.Random(2)
    edges = [(i, (i + 1) % 60) for i in range(60)] + [(100 + i, 101 + i) for i in range(80)] + [(500, j) for j in range(100, 140)] + [(59, 100), (150, 500), (170, 170), (None, 3), (4, None)] + [(rng.randint(200, 260), rng.randint(200, 260)) for _ in range(70)]
    for seeds in ([5], [100, 230], [999, None], []):
        want, todo = set(), [s for s in seeds if s is not None]
        while todo:
            x = todo.pop()
            if x not in want:
                want.add(x)
                todo += [d for s, d in edges if s == x and d is not None]
        got = closure.reachable(spark.createDataFrame([(s,) for s in seeds], "id long"), spark.createDataFrame(edges, "src long, dst long"))
        assert sorted(r["id"] for r in got.collect()) == sorted(want)


def test_needles_are_keyed_by_their_rarest_word(spark):
    """All needles share their longest word; what is compared stays near what matches."""
    texts = spark.range(3000).select(F.col("id").alias("k"), F.concat(F.lit("a verylongcommonword x"), (F.col("id") % 500).cast("string"), F.lit(" tail z")).alias("t"))
    needles = spark.range(500).select(F.col("id").alias("n"), F.concat(F.lit("verylongcommonword x"), F.col("id").cast("string"), F.lit(" tail")).alias("s"))
    words = texts.select(F.col("k").alias("__key"), F.explode(F.split("t", " ")).alias("seed"))
    seeds = needles.select("n", F.explode(F.split("s", " ")).alias("seed"))
    assert joins._by_rarest(words, seeds, "n").count() == 3000
    found = joins.contained(texts, "k", "t", needles, "n", "s")
    assert found.count() == 3000 and found.where("k % 500 <> n").isEmpty()
