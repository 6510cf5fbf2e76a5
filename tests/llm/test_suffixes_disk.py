"""Tables of bytes that are done with are removed before the next ones are written."""

import os

import numpy as np

from atomweave.llm import suffixes


def test_contexts_are_gone_when_they_are_judged(spark, monkeypatch):
    rng = np.random.default_rng(9)
    words = lambda k: " ".join(f"w{x}" for x in rng.integers(0, 30_000, k))
    same = words(80)
    df = spark.createDataFrame([(i, " ".join([words(40), same, words(40)])) for i in range(12)], "doc_id long, text string")
    made, staged = {}, suffixes.staged

    def noted(df):
        out = staged(df)
        if out.inputFiles():
            made[tuple(out.columns)] = os.path.dirname(out.inputFiles()[0]).removeprefix("file://")
        return out

    monkeypatch.setattr(suffixes, "staged", noted)
    rows = suffixes.digest(df).collect()
    assert all(r["n_removed"] >= len(same) for r in rows)
    gone = {c for c, folder in made.items() if not os.path.exists(folder)}
    assert ("v", "rank", "n", "mask", "left", "around") in gone and ("id", "ats") in gone
