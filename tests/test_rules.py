"""Many rules by their index against comparing each row with each rule."""

import random

from pyspark.sql import functions as F

from atomweave.operators import rules

TEXT = ["mode", "context", "name", "file"]
FLAGS = ["has_ensures", "has_requires", "has_decreases", "has_trusted_assumption"]
CALLS = sorted({c for c, how in rules.CRITERIA.values() if how == "calls"})


def catalog(spark, rng, n):
    word = lambda: rng.choice(["lemma_add", "axiom_x", "add", "new", "", "is_valid", "é", "p/src/a.rs", "spec"])
    rows = [(i, *[rng.choice([None, word(), word()]) for _ in TEXT], *[rng.choice([True, False, None]) for _ in FLAGS], *[rng.choice([None, [word() for _ in range(rng.randint(0, 3))]]) for _ in CALLS]) for i in range(n)]
    return spark.createDataFrame(rows, "id long, " + ", ".join([f"{c} string" for c in TEXT] + [f"{c} boolean" for c in FLAGS] + [f"{c} array<string>" for c in CALLS]))


def rule_table(spark, rng, n):
    part = lambda: rng.choice(["lem", "add", "x", "", "valid", "src/", "spec", "é", "zzz", "new"])
    made = []
    for i in range(n):
        row = {c: None for c in rules.CRITERIA}
        for c in rng.sample(list(rules.CRITERIA), rng.randint(0, 4)):
            row[c] = rng.choice([True, False]) if rules.CRITERIA[c][1] in ("is", "empty") else [part() for _ in range(rng.randint(0, 2))]
        made.append((i, f"l{i % 7}", "", "", *row.values()))
    return spark.createDataFrame(made, rules.RULE_SCHEMA)


def test_all_criteria_by_the_index(spark, monkeypatch):
    rng = random.Random(4)
    df, table = catalog(spark, rng, 60), rule_table(spark, rng, 120)
    seen = {c for r in table.collect() for c in rules.CRITERIA if r[f"c_{c}"] is not None}
    assert seen == set(rules.CRITERIA) and len(seen) == 18
    plain = sorted((r["id"], r["pos"]) for r in rules.apply_rules(df, table).collect())
    assert sorted((r["id"], r["pos"]) for r in rules.apply_rules(df, table, keys=["id"]).collect()) == plain
    monkeypatch.setattr(rules, "FEW_RULES", 10**6)
    few = {r["id"]: r["spec_labels"] for r in rules.labels(df, table, ["id"]).collect()}
    monkeypatch.setattr(rules, "FEW_RULES", 0)
    assert {r["id"]: r["spec_labels"] for r in rules.labels(df, table, ["id"]).collect()} == few


def test_ten_thousand_rules_meet_few_rows(spark):
    names = spark.range(2000).select(F.col("id"), F.concat(F.lit("lemma_"), F.col("id").cast("string"), F.lit("_x")).alias("name"))
    columns = ", ".join(f"CAST(NULL AS {'boolean' if how in ('is', 'empty') else 'array<string>'}) AS c_{c}" for c, (_, how) in rules.CRITERIA.items() if c != "name_contains")
    table = spark.range(10_000).selectExpr("int(id) AS pos", "concat('l', id) AS label", "'' AS description", "'' AS trust", "array(concat('_', id, '_')) AS c_name_contains", columns.split(", ")[0], *columns.split(", ")[1:])
    met = rules._candidates(names, table, ["name_contains"], ["id"])
    assert met.count() == 2000 and rules.apply_rules(names, table, keys=["id"]).where("pos <> id").isEmpty()
