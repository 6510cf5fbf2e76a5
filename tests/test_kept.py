"""A second run over changed files reads and writes their rows alone, and gives what a full run gives."""

import os

from pyspark.sql import functions as F

from atomweave.plans import verifylog
from atomweave.sources import kept


def test_only_changed_logs_are_worked_on(spark, tmp_path):
    logs, out = tmp_path / "logs", tmp_path / "kept"
    logs.mkdir()
    text = lambda n: "".join(f"error: assertion failed\n  --> src/f{i}.rs:{i + 1}:2\n\n" for i in range(n))
    for i in range(6):
        (logs / f"l{i}.txt").write_text(text(i))
    seen = []

    def work(changed):
        seen.append(sorted(r["key"].rsplit("/", 1)[-1] for r in changed.collect()))
        found = verifylog.failures(verifylog.log_lines(kept.texts(changed).select(F.col("key").alias("log_id"), "text")))
        return found.select(F.col("log_id").alias("key"), "pos", "error_type", "file", "line_number")

    def full():
        return sorted(map(tuple, work(kept.files(spark, str(logs), "*.txt")).collect()))

    def run():
        return sorted(map(tuple, kept.refresh(kept.files(spark, str(logs), "*.txt"), str(out), work).collect()))

    assert run() == full() and len(run()) == 15
    assert seen[-1] == []  # the second run had nothing to do
    (logs / "l2.txt").write_text(text(9))
    os.utime(logs / "l2.txt", (1, 1))
    (logs / "l4.txt").unlink()
    (logs / "l9.txt").write_text(text(1))
    seen.clear()
    got = run()
    assert seen == [["l2.txt", "l9.txt"]]
    written = spark.read.parquet(str(out / "rows")).where("run = 1")
    assert {r["key"].rsplit("/", 1)[-1] for r in written.collect()} == {"l2.txt", "l9.txt"}
    assert got == full() and len(got) == 9 + 1 + 0 + 1 + 3 + 5
