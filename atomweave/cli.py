"""Commands: ``python -m atomweave.cli COMMAND ...``.  Exit code 0 is success; ``run`` also ends so on failed proofs."""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from atomweave.functions import paths
from atomweave.plans import callgraph, specs, verifylog
from atomweave.sources import documents, index, rustsource, sinks

ATOM_COLUMNS = ["display_name", "dependencies", "code_module", "code_path", "lines_start", "lines_end", "mode"]


FUNCTION_COLUMNS = ["name", "file", "mode", "kind", "visibility", "context", "specified", "has_requires", "has_ensures", "has_decreases", "has_trusted_assumption", "display_name"]


def session() -> SparkSession:
    return SparkSession.builder.appName("atomweave").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def functions(spark: SparkSession, path: str, methods: bool = True) -> DataFrame:
    return rustsource.functions(rustsource.read_sources(spark, path), methods)


def atomize(spark: SparkSession, a: argparse.Namespace) -> int:
    if not Path(a.project, "Cargo.toml").exists():
        print(f"{a.project} has no Cargo.toml", file=sys.stderr)
        return 1
    symbols, occurrences = index.read_index(spark, a.index or f"{a.project}/data/index.scip.json")
    spans = rustsource.spans(functions(spark, a.project))
    atoms = callgraph.atoms(symbols, occurrences, spans, a.with_locations, a.name_match).cache()
    double = callgraph.duplicate_names(atoms).collect()
    if double:
        for r in double:
            print(f"duplicate code name {r['code_name']}: {r['n']} functions", file=sys.stderr)
        return 1
    sinks.write_text(sinks.dictionary(atoms, "code_name", ATOM_COLUMNS + (["dependencies_with_locations"] if a.with_locations else [])), a.output)
    n = atoms.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.size("dependencies")), F.lit(0)).alias("d")).first()
    print(f"{n['n']} atoms, {n['d']} dependencies -> {a.output}")
    return 0


def list_functions(spark: SparkSession, a: argparse.Namespace) -> int:
    found = functions(spark, a.path, not a.exclude_methods).where("name IS NOT NULL")
    if a.exclude_verus_constructs:
        found = found.where("mode <> 'spec'")
    if a.output or a.format == "json":
        columns = [c for c in FUNCTION_COLUMNS if c in found.columns]
        one = F.struct(*[F.col(c).alias(c.replace("_", "-")) for c in columns], F.struct(F.col("lines_start").alias("lines-start"), F.col("lines_end").alias("lines-end")).alias("spec-text"))
        by_file = found.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("lines_start", one.alias("f")))).alias("l")).select("file", F.transform("l", lambda x: x["f"]).alias("l"))
        whole = by_file.agg(F.sort_array(F.collect_list(F.struct("file", "l"))).alias("a")).select(
            F.to_json(F.struct(
                F.flatten(F.transform("a", lambda x: x["l"])).alias("functions"), F.map_from_entries(F.transform("a", lambda x: F.struct(x["file"], x["l"]))).alias("functions_by_file"),
                F.struct(F.aggregate("a", F.lit(0), lambda n, x: n + F.size(x["l"])).alias("total_functions"), F.size("a").alias("total_files")).alias("summary"),
            )).alias("value")
        )
        sinks.write_text(whole, a.output or "functions.json")
    elif a.format == "text":
        print(*[r["name"] for r in specs.names(found).toLocalIterator()], sep="\n")
    else:
        for r in found.orderBy("file", "lines_start").toLocalIterator():
            print(f"{r['name']} [{r['kind']}] ({r['visibility']}) @ {r['file']}:{r['lines_start']}:{r['lines_end']} in {r['context']}")
        n = specs.summary(found).first()
        print(f"\nSummary: {n['total_functions']} functions in {n['total_files']} files")
    return 0


def specify(spark: SparkSession, a: argparse.Namespace) -> int:
    rules, stop = documents.read_rules(spark, a.taxonomy_config) if a.taxonomy_config else (None, None)
    found, atoms = functions(spark, a.src), index.read_atoms(spark, a.with_atoms)
    out = specs.specified(found, atoms, rules, stop).cache()
    print(specs.matches(found, atoms).first().asDict())
    columns = ["name", "file", "mode", "context", "specified", "has_requires", "has_ensures", "has_decreases", "has_trusted_assumption", "requires_text", "ensures_text", "ensures_calls", "requires_calls", "lines_start", "lines_end"]
    sinks.write_text(sinks.dictionary(out, "code_name", columns + (["spec_labels"] if rules is not None else [])), a.output)
    if rules is not None:
        print(specs.coverage(out).first().asDict())
        if a.explain:
            for r in specs.explained(out, rules, stop).orderBy("code_name", "pos").toLocalIterator():
                print(f"{r['code_name']}  {'MATCHED' if r['matched'] else 'missed'} {r['label']}" + (f" (failed: {', '.join(r['failed'])})" if r["failed"] else ""), file=sys.stderr)
    return 0


def verify(spark: SparkSession, a: argparse.Namespace) -> int:
    project, code, path = a.project, a.exit_code, a.from_file
    if path is None:
        try:
            project, code, path = sinks.read_cache(a.data)
        except OSError:
            print("no verifier output is given or kept", file=sys.stderr)
            return 1
    lines = documents.read_log_lines(spark, path).withColumn("log_id", F.lit("log"))
    logs = spark.createDataFrame([("log", code)], "log_id string, exit_code int")
    if a.from_file and a.data:
        sinks.write_cache(a.data, project, a.package, code, Path(path).read_text())
    found = functions(spark, project).where("name IS NOT NULL AND mode <> 'spec'").withColumn("log_id", F.lit("log"))
    rows, summary = verifylog.analyze(logs, found, a.verify_only_module, a.verify_function, lines)
    state = summary.first().asDict()
    if a.with_atoms:
        sinks.write_text(sinks.dictionary(verifylog.proofs(rows, index.read_atoms(spark, a.with_atoms)), "code_name", ["code_path", "code_line", "verified", "status"]), a.output)
    else:
        listed = {c: [{"display-name": r["name"], "code-path": r["file"], "code-text": {"lines-start": r["lines_start"], "lines-end": r["lines_end"]}} for r in rows.where(F.col("category") == c).orderBy("file", "lines_start").toLocalIterator()] for c in ("failed", "verified", "unverified")}
        errors = verifylog.failures(lines).orderBy("pos").select("error_type", "file", F.col("line_number").alias("line"), "column", "message", "assertion_details", "full_error_text")
        told = verifylog.messages(lines).orderBy("seq").select("level", "message", "file", F.col("line_number").alias("line"), "column", "full_message")
        said = lambda level: [{k: v for k, v in r.asDict().items() if k != "level"} for r in told.where(F.col("level") == level).toLocalIterator()]
        sinks.write_json(
            {
                "status": state["status"], "summary": {k: v for k, v in state.items() if k not in ("log_id", "status")},
                "verification": {f"{c}_functions": x for c, x in listed.items()} | {"errors": [r.asDict() for r in errors.toLocalIterator()]}, "compilation": {"errors": said("error"), "warnings": said("warning")},
            }, a.output,
        )
    print(state)
    a.status = state["status"]
    return 0 if state["status"] == "success" else 1


def specs_data(spark: SparkSession, a: argparse.Namespace) -> int:
    entries = documents.read_entrypoints(spark, a.entrypoints) if a.entrypoints else None
    found = functions(spark, a.src)
    spec_rows, done = specs.browser(found, entries, a.base_url, a.prefix or paths.project_prefix(a.src))
    print(specs.browser_counts(found, spec_rows, done).first().asDict())
    one = spec_rows.agg(F.collect_list(F.struct(*spec_rows.columns)).alias("spec_functions")).crossJoin(done.agg(F.collect_list(F.struct(*done.columns)).alias("verified_functions")))
    sinks.write_text(one.select(F.to_json(F.struct("spec_functions", "verified_functions")).alias("value")), a.output)
    return 0


def tracked_csv(spark: SparkSession, a: argparse.Namespace) -> int:
    rows = specs.tracked(functions(spark, a.src), a.base_url, a.prefix or paths.project_prefix(a.src))
    Path(a.output).write_text("\n".join([",".join(rows.columns), *[r["value"] for r in sinks.csv_lines(rows, not a.unquoted).toLocalIterator()]]) + "\n")
    print(specs.completion(rows).first().asDict())
    return 0


def stubify(spark: SparkSession, a: argparse.Namespace) -> int:
    found = documents.read_stubs(spark, a.path)
    sinks.write_text(sinks.dictionary(found.where("ok"), "stub", ["code_line", "code_path", "code_name"]), a.output)
    failed = found.where("NOT ok").count()
    if failed:
        print(f"{failed} files without front matter", file=sys.stderr)
    return 0


def run(spark: SparkSession, a: argparse.Namespace) -> int:
    out = Path(a.output)
    first = argparse.Namespace(**vars(a) | {"output": str(out / "atoms.json"), "with_locations": False})
    second = argparse.Namespace(**vars(a) | {"output": str(out / "proofs.json"), "with_atoms": str(out / "atoms.json"), "verify_only_module": None, "verify_function": None})
    codes = [atomize(spark, first)]
    if not codes[0]:
        codes.append(verify(spark, second))
    status = getattr(second, "status", "atomize_failed")
    sinks.write_json({"status": status, "atomize": codes[0] == 0, "verify": len(codes) > 1 and codes[1] == 0}, str(out / "run_summary.json"))
    return 0 if status in ("success", "verification_failed") else 1


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="atomweave")
    sub = top.add_subparsers(dest="command", required=True)

    def add(name, f, output, *arguments):
        p = sub.add_parser(name)
        p.set_defaults(f=f)
        p.add_argument("-o", "--output", default=output)
        for flags, more in arguments:
            p.add_argument(*flags, **more)

    yes = {"action": "store_true"}
    link = [(["--base-url"], {"default": ""}), (["--prefix"], {"default": ""})]
    graph = [(["project"], {}), (["--index"], {}), (["--name-match"], {"choices": ["bare", "enriched"], "default": "bare"})]
    log = [(["--from-file"], {}), (["--exit-code"], {"type": int, "default": 0}), (["--package"], {}), (["--data"], {"default": "data"})]
    add("atomize", atomize, "atoms.json", *graph, (["--with-locations"], yes))
    add("list-functions", list_functions, None, (["path"], {}), (["--format"], {"choices": ["text", "json", "detailed"], "default": "text"}), (["--exclude-verus-constructs"], yes), (["--exclude-methods"], yes))
    add("specify", specify, "specs.json", (["src"], {}), (["-a", "--with-atoms"], {"required": True}), (["--taxonomy-config"], {}), (["--explain"], yes))
    add("verify", verify, "proofs.json", (["project"], {}), (["-a", "--with-atoms"], {}), (["--verify-only-module"], {}), (["--verify-function"], {}), *log)
    add("specs-data", specs_data, "specs_data.json", (["src"], {}), (["--entrypoints"], {}), *link)
    add("tracked-csv", tracked_csv, "tracked.csv", (["src"], {}), (["--unquoted"], yes), *link)
    add("stubify", stubify, "stubs.json", (["path"], {}))
    add("run", run, "output", *graph, *log)
    return top


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(arguments)
    for name in ("project", "path", "src", "from_file", "with_atoms", "taxonomy_config", "entrypoints"):
        if getattr(a, name, None) and not Path(getattr(a, name)).exists():
            print(f"{getattr(a, name)} does not exist", file=sys.stderr)
            return 1
    return a.f(spark or session(), a)


if __name__ == "__main__":
    sys.exit(main())
