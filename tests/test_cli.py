import json

from test_callgraph import occurrence, symbol, write
from test_verify import LOG, SOURCE

from atomweave import cli
from atomweave.plans import specs
from atomweave.streaming.logs import stream_failures


def test_commands(spark, tmp_path):
    src = tmp_path / "p" / "src"
    src.mkdir(parents=True)
    (src / "a.rs").write_text(SOURCE)
    occ = [occurrence([5, 7, 18], "a/public_func().", 1), occurrence([19, 11, 17], "a/Table#method().", 1), occurrence([20, 4, 8], "a/public_func().")]
    index = write(tmp_path, [("src/a.rs", occ, [symbol("a/public_func()."), symbol("a/Table#method().")])])
    log = tmp_path / "log.txt"
    log.write_text(LOG.replace("src/a.rs:5:9", "src/a.rs:20:9"))
    out = tmp_path / "out"
    assert cli.main(["atomize", str(tmp_path / "p"), "--index", index, "-o", str(out / "atoms.json")], spark) == 1
    (tmp_path / "p" / "Cargo.toml").write_text("")
    assert cli.main(["run", str(tmp_path / "p"), "--index", index, "--from-file", str(log), "--exit-code", "1", "-o", str(out), "--data", str(tmp_path / "data")], spark) == 0
    atoms = json.loads((out / "atoms.json").read_text())
    assert atoms["probe:c/1.0.0/a/Table#method()"]["dependencies"] == ["probe:c/1.0.0/a/public_func()"]
    assert atoms["probe:c/1.0.0/a/Table#method()"]["code-text"] == {"lines-start": 20, "lines-end": 22}
    proofs = json.loads((out / "proofs.json").read_text())
    assert {k.rsplit("/")[-1]: v["status"] for k, v in proofs.items()} == {"Table#method()": "failure", "public_func()": "sorries"}
    assert json.loads((out / "run_summary.json").read_text())["status"] == "verification_failed"
    assert cli.main(["specify", str(tmp_path / "p"), "-a", str(out / "atoms.json"), "-o", str(out / "specs.json")], spark) == 0
    assert json.loads((out / "specs.json").read_text())["probe:c/1.0.0/a/public_func()"]["requires-calls"] == ["is_small"]
    assert cli.main(["tracked-csv", str(tmp_path / "p"), "-o", str(out / "t.csv")], spark) == 0
    assert "Table<T>::method,a," in (out / "t.csv").read_text()
    assert cli.main(["specs-data", str(tmp_path / "p"), "-o", str(out / "d.json")], spark) == 0
    assert len(json.loads((out / "d.json").read_text())["spec_functions"]) == 3
    # the output kept by run() is analysed again, in full
    assert cli.main(["verify", str(tmp_path / "p"), "--data", str(tmp_path / "data"), "-o", str(out / "full.json")], spark) == 1
    full = json.loads((out / "full.json").read_text())
    assert [e["error_type"] for e in full["verification"]["errors"]] == ["postcondition not satisfied"] and full["verification"]["errors"][0]["line"] == 20
    assert set(full["compilation"]) == {"errors", "warnings"} and full["summary"]["verification_errors"] == 1
    assert cli.main(["verify", str(tmp_path / "p"), "--data", str(tmp_path / "none")], spark) == 1
    assert cli.main(["list-functions", str(tmp_path / "p"), "-o", str(out / "f.json")], spark) == 0
    listed = json.loads((out / "f.json").read_text())
    (row,) = specs.by_file(cli.functions(spark, str(tmp_path / "p"))).collect()
    assert row["file"] == "src/a.rs" and [f["name"] for f in row["functions"]] == [f["name"] for f in listed["functions"]]
    assert listed["summary"]["total_files"] == 1 and listed["summary"]["total_functions"] == len(listed["functions"]) == len(listed["functions_by_file"]["src/a.rs"])
    assert cli.main(["stubify", str(tmp_path / "nowhere")], spark) == 1


def test_arriving_logs(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "l.txt").write_text(LOG)
    stream_failures(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).first()["error_type"] == "postcondition not satisfied"
