"""Logs of any length: messages against a plain state machine, lines read in splits against lines of whole files."""

import random
import re

import pytest
from pyspark.sql import functions as F

from atomweave.functions.text import lines_of
from atomweave.plans import verifylog
from atomweave.sources import documents

KINDS = [(k, re.compile(p)) for k, p in verifylog._KINDS]


def plain(text):
    """The messages of a log, line by line."""
    done, open_ = [], {}
    finished = any(re.search(verifylog.RESULTS, x) for x in lines_of(text))

    def begin(level, message, line):
        if level in open_:
            done.append(open_.pop(level))
        open_[level] = {"level": level, "message": message, "place": (None, None, None), "lines": [line]}

    for line in map(str.strip, lines_of(text)):
        kind, m = next(((k, m) for k, p in KINDS if (m := p.search(line))), (None, None))
        error = open_.get("error")
        if kind in (None, "results", "failure") or kind == "crate" and finished:
            continue
        if kind in ("memory", "exit", "process") and error:
            error["lines"].append(line)
            error["message"] += {"memory": f" - {line}", "exit": f" (exit code: {m[1]})" if kind == "exit" else "", "process": f" - {m[1]}" if kind == "process" else ""}[kind]
        elif kind == "memory":
            done.append({"level": "error", "message": line, "place": (None, None, None), "lines": [line]})
        elif kind in ("crate", "exit", "process", "error", "warning"):
            text = {"crate": "Compilation failed for crate: ", "exit": "Verus command failed with exit code ", "process": "Process execution failed: "}.get(kind, "") + (m[1] if kind in ("crate", "exit", "process") else m[1].strip())
            begin("warning" if kind == "warning" else "error", text, line)
        elif kind == "blank":
            done += [open_.pop(level) for level in ("error", "warning") if level in open_]
        elif one := error or open_.get("warning"):
            one["lines"].append(line)
            if kind == "place":
                one["place"] = (m[1], *(int(x) if int(x) < 1 << 31 else 0 for x in (m[2], m[3])))
            elif one is error:
                if line.startswith("Caused by:") or "(signal:" in line:
                    one["message"] += f" - {line}"
                if status := re.search(r"\(exit status: (\d+)\)", line):
                    one["message"] += f" (exit status: {status[1]})"
    return [(m["level"], m["message"], *m["place"], m["lines"]) for m in [*done, *open_.values()]]


SAID = ["error: bad", "error[E0308]:  odd ", "  --> src/a.rs:3:4", " --> b c.rs:99999999999:1", "", " \t", "warning: w", "error: could not compile `c` due to", "= note", "| x", "^^", "Caused by: boom", "Caused by: (signal: 9) (exit status: 4)", "process didn't exit successfully: `r` (exit status: 101)", "memory allocation of 12 bytes failed", "Verus command completed with exit code: 3", "what", "(signal: 6, abort)", "(exit status: 2)", "error: assertion failed", "x error: y warning: z"]


@pytest.mark.parametrize("piece", [7, 1000])
def test_messages_equal_a_state_machine(spark, monkeypatch, piece):
    monkeypatch.setattr(verifylog, "PIECE", piece)
    rng = random.Random(piece)
    texts = ["\n".join(rng.choice(SAID) for _ in range(rng.randint(0, 120))) + rng.choice(["", "\n", "\n\n", "\r\n"]) for _ in range(25)]
    texts += [t + "\nverification results:: 2 verified, 1 errors\n" + texts[0] for t in texts[:8]] + [None, "", "\n", "error: only"]
    lines = verifylog.log_lines(spark.createDataFrame(list(enumerate(texts)), "log_id long, text string"))
    got = {}
    for r in verifylog.messages(lines).orderBy("log_id", "seq").collect():
        assert r["seq"] == len(got.setdefault(r["log_id"], []))
        got[r["log_id"]].append((r["level"], r["message"], r["file"], r["line_number"], r["column"], r["full_message"]))
    for i, text in enumerate(texts):
        assert got.get(i, []) == plain(text or ""), text
    assert verifylog.messages(lines.where("log_id < 0")).collect() == []


def test_messages_use_no_python(spark):
    lines = verifylog.log_lines(spark.createDataFrame([(1, "error: x")], "log_id long, text string"))
    for df in (verifylog._states(lines), verifylog.messages(lines)):
        assert not re.search("Python|Pandas|InArrow", df._jdf.queryExecution().executedPlan().toString())


@pytest.mark.parametrize("split", [64, 1000])
def test_lines_of_splits_are_those_of_whole_files(spark, tmp_path, split):
    """Borders of splits fall everywhere: within lines, between a carriage return and its line feed, at line ends."""
    rng = random.Random(split)
    for n in range(6):
        text = "".join("".join(rng.choice("abc é") for _ in range(rng.randint(0, 9))) + rng.choice(["\n", "\r\n", "\r\n", "\n\n"]) for _ in range(400)) + rng.choice(["", "end", "end\r\n"])
        (tmp_path / f"log{n}.txt").write_bytes(text.encode())
    (tmp_path / "empty.txt").write_bytes(b"")
    (tmp_path / "blank.txt").write_bytes(b"\r\n")
    held = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        read = documents.read_log_lines(spark, str(tmp_path))
        splits = read.select(F.col("pos")).count() and len({r[0] for r in spark.read.text(str(tmp_path)).select("_metadata.file_block_start").distinct().collect()})
        assert splits > 1
        got = sorted((r["log_id"], r["pos"], r["line"]) for r in read.collect())
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)
    want = [(p.name, n + 1, line) for p in tmp_path.iterdir() for n, line in enumerate(lines_of(p.read_bytes().decode()))]
    assert got == sorted(want)


def test_one_log_is_many_tasks(spark, monkeypatch):
    """Locations, failures and messages of a log that is cut into pieces are those of the whole."""
    rng = random.Random(17)
    said = [*SAID, "error: postcondition not satisfied", "note: function g has been running for 2 s", "note: finished in 3 s"]
    text = "\n".join(rng.choice(said) for _ in range(3000))
    lines = verifylog.log_lines(spark.createDataFrame([("one", text)], "log_id string, text string"))
    views = [lambda: verifylog.locations(lines), lambda: verifylog.failures(lines), lambda: verifylog.messages(lines)]
    whole = [sorted(map(str, v().collect())) for v in views]
    monkeypatch.setattr(verifylog, "PIECE", 50)
    assert [sorted(map(str, v().collect())) for v in views] == whole
    spread = lines.select(F.floor(F.col("pos") / 50).alias("b")).distinct().count()
    assert spread > 50 and all(whole)
