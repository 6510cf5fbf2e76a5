from pyspark.sql import functions as F

from atomweave.operators import joins, rules
from atomweave.plans import specs, verifylog
from atomweave.sources import documents, rustsource
from atomweave.sources.rustsource import Source

LOG = """error: postcondition not satisfied
  --> src/a.rs:5:9
   |
5  |     x
   | ^^^

note: function foo has been running for 2 seconds
  --> src/a.rs:20:1

verification results:: 3 verified, 1 errors
"""
BROKEN = """warning: unused variable
  --> src/b.rs:3:4
error[E0425]: cannot find value `y`
  --> src/b.rs:7:9
   |
   = help: none

error: could not compile `thing` (lib)
Caused by:
  process didn't exit successfully: `rustc` (exit status: 101)
"""
SOURCE = '''use x::y;
verus! {
/// Adds.
/// mod(a, n) = a % n
#[verifier::external_body]
pub fn public_func<T>(a: u32, b: Option<T>) -> (r: u32)
    requires
        a < 10, is_small(a),
    ensures
        r == spec_add(a as int, limbs::value(&b).scale(3)),
{
    assume(true);
    a
}
fn private_func() -> bool { let s = "fn not_one() {"; true }
pub open spec fn spec_add(a: int, b: int) -> int { helper(a) + b }
spec fn helper(a: int) -> int { a }
proof fn axiom_small(x: u32) ensures is_small(x) { }
impl<T> Table<T> {
    pub fn method(&self) -> u32
        ensures match self { Table(x) => true, }, spec_add(1, 2) == 3,
    { fn inner() {} 1 }
}
impl From<&'a Point> for Table<X> { fn from(p: &Point) -> Self { todo!() } }
trait Act { fn act(&self) requires true; }
}
mod deep { pub(crate) const fn nested() {} }
'''


def test_log_locations_and_failures(spark):
    lines = verifylog.log_lines(spark.createDataFrame([("l", LOG)], "log_id string, text string"))
    assert [(r["file"], r["line_number"]) for r in verifylog.locations(lines).collect()] == [("src/a.rs", 5)]
    (f,) = verifylog.failures(lines).collect()
    assert (f["error_type"], f["file"], f["line_number"], f["column"]) == ("postcondition not satisfied", "src/a.rs", 5, 9)
    assert f["assertion_details"] == ["  --> src/a.rs:5:9", "   |", "5  |     x", "   | ^^^"]
    assert f["full_error_text"].endswith("| ^^^")


def told(spark, text):
    lines = verifylog.log_lines(spark.createDataFrame([("l", text)], "log_id string, text string"))
    return verifylog.messages(lines).orderBy("seq").collect()


def test_compiler_messages(spark):
    (w, e, c) = list(sorted(told(spark, BROKEN), key=lambda m: (m["level"] != "warning", m["message"] != "cannot find value `y`")))
    # a place after a newer error belongs to it
    assert (w["message"], w["file"], w["line_number"]) == ("unused variable", "src/b.rs", 3)
    assert (e["message"], e["file"], e["line_number"], e["column"]) == ("cannot find value `y`", "src/b.rs", 7, 9)
    assert c["message"].startswith("Compilation failed for crate: thing - Caused by: - `rustc`")
    assert told(spark, LOG) == []


def test_analysis(spark):
    logs = spark.createDataFrame([("l", LOG, 1), ("broken", BROKEN, 1)], "log_id string, text string, exit_code int")
    own = [(i, n, "src/a.rs", a, b, False, True, t) for i in ("l", "broken") for n, a, b, t in (("foo", 1, 8, False), ("inner", 4, 6, False), ("other", 20, 30, False), ("lazy", 40, 50, True))]
    functions = spark.createDataFrame(own, "log_id string, name string, file string, lines_start long, lines_end long, has_requires boolean, has_ensures boolean, has_trusted_assumption boolean")
    rows, summary = verifylog.analyze(logs, functions)
    assert {r["name"]: r["category"] for r in rows.collect()} == {"foo": "verified", "inner": "failed", "other": "verified", "lazy": "unverified"}
    s = {r["log_id"]: r.asDict() for r in summary.collect()}
    assert (s["l"]["status"], s["l"]["failed_functions"], s["l"]["verification_errors"], s["l"]["compilation_errors"]) == ("verification_failed", 1, 1, 0)
    assert (s["broken"]["status"], s["broken"]["total_functions"], s["broken"]["compilation_errors"], s["broken"]["compilation_warnings"]) == ("compilation_failed", 0, 2, 1)
    atoms = spark.createDataFrame([("probe:inner", "T::inner", "p/src/a.rs", 5), ("probe:lazy", "lazy", "src/a.rs", 44), ("probe:far", "foo", "src/a.rs", 99)], "code_name string, display_name string, code_path string, lines_start long")
    assert {(r["code_name"], r["status"]) for r in verifylog.proofs(rows, atoms).collect()} == {("probe:inner", "failure"), ("probe:lazy", "sorries")}


def catalog(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "a.rs").write_text(SOURCE)
    (tmp_path / "src" / "bad.rs").write_text("fn f() { (")
    return rustsource.functions(rustsource.read_sources(spark, str(tmp_path)))


def test_source_parser(spark, tmp_path):
    rows = catalog(spark, tmp_path)
    by = {r["name"]: r for r in rows.where("name IS NOT NULL").collect()}
    assert set(by) == {"public_func", "private_func", "spec_add", "helper", "axiom_small", "method", "inner", "from", "act", "nested"}
    p = by["public_func"]
    assert (p["file"], p["lines_start"], p["lines_end"], p["mode"], p["visibility"], p["context"]) == ("src/a.rs", 3, 14, "exec", "pub", "standalone")
    assert p["is_external_body"] and p["has_trusted_assumption"] and p["specified"] and not p["has_decreases"]
    assert p["requires_calls"] == ["is_small"] and p["ensures_calls"] == ["spec_add", "scale", "value"]
    assert p["ensures_calls_full"] == ["spec_add", "scale", "limbs::value"] and p["ensures_method_calls"] == ["scale"]
    assert (p["requires_text"], p["req_start"], p["ens_end"]) == ("requires\n        a < 10, is_small(a),", 7, 10)
    assert p["doc_comment"] == "Adds.\nmod(a, n) = a % n" and p["signature_text"].startswith("pub fn public_func<T>")
    assert (by["method"]["display_name"], by["method"]["context"], by["method"]["ensures_calls"]) == ("Table<T>::method", "impl", ["spec_add"])
    assert by["from"]["display_name"] == "Table<X>::from" and by["act"]["has_requires"] and by["act"]["context"] == "trait"
    assert (by["spec_add"]["kind"], by["nested"]["kind"], by["nested"]["visibility"]) == ("spec fn", "const fn", "pub(crate)")
    assert rows.where("parse_error IS NOT NULL").count() == 1
    few = rustsource.functions(rustsource.read_sources(spark, str(tmp_path)), methods=False)
    assert {r["name"] for r in few.where("name IS NOT NULL").collect()} == set(by) - {"method", "inner", "from", "act"}


def test_specs_and_tracked(spark, tmp_path):
    rows = catalog(spark, tmp_path)
    spec_rows, verified = specs.browser(rows, base_url="https://x/")
    assert [(r["name"], r["category"], r["referenced_specs"]) for r in spec_rows.collect()] == [("axiom_small", "axiom", []), ("helper", "spec", []), ("spec_add", "spec", ["helper"])]
    (v,) = [r for r in verified.collect() if r["name"] == "method"]
    assert v["referenced_specs"] == ["spec_add"] and v["has_proof"] and v["github_link"] == "https://x/src/a.rs#L20"
    assert {r["function"]: r["has_proof"] for r in specs.tracked(rows).collect()} == {"Table<T>::method": "yes", "act": "yes"}
    assert specs.completion(specs.tracked(rows)).first().asDict() == {"total": 2, "proved": 2, "percent": 100}
    assert specs.names(rows).first()["name"] == "act"
    assert rows.select(specs.math_interpretation(F.col("doc_comment")).alias("m")).where("m <> ''").first()["m"] == "mod(a, n) = a % n"


RULES = """version = "1"
stop_words = ["len", "old", "unwrap"]
[[rules]]
label = "data-invariant"
description = "d"
trust = "t"
[rules.match]
ensures_calls_contain = ["is_canonical"]
[[rules]]
label = "functional-correctness"
description = "d"
trust = "t"
[rules.match]
ensures_calls_contain = ["_to_nat"]
mode = ["exec"]
[[rules]]
label = "memory-safety"
description = "d"
trust = "t"
[rules.match]
has_ensures = true
ensures_calls_empty = true
mode = ["exec"]
"""


def test_rules(spark, tmp_path):
    (tmp_path / "r.toml").write_text(RULES)
    table, stop = documents.read_rules(spark, str(tmp_path / "r.toml"))
    rows = [("a", "exec", True, ["is_canonical_scalar52", "scalar52_to_nat"]), ("b", "exec", True, []), ("c", "exec", True, ["len", "old"]), ("d", "exec", True, ["len", "recover"]), ("e", "proof", True, ["x_to_nat"])]
    df = rules.without_stop_words(spark.createDataFrame(rows, "name string, mode string, has_ensures boolean, ensures_calls array<string>"), stop)
    got = {r["name"]: r["spec_labels"] for r in rules.labels(df, table, ["name"]).collect()}
    assert got == {"a": ["data-invariant", "functional-correctness"], "b": ["memory-safety"], "c": ["memory-safety"], "d": [], "e": []}
    told = {(r["label"], r["criterion"]): r["passed"] for r in rules.explain(df.where("name = 'e'"), table, ["name"]).collect()}
    assert told[("functional-correctness", "mode")] is False and told[("functional-correctness", "ensures_calls_contain")] is True


def test_explained_and_tracked_matches(spark, tmp_path):
    (tmp_path / "r.toml").write_text(RULES)
    table, stop = documents.read_rules(spark, str(tmp_path / "r.toml"))
    df = spark.createDataFrame([("p", "a", "proof", True, True, ["x_to_nat"]), ("q", "b", "exec", False, False, ["f"])], "code_name string, name string, mode string, has_ensures boolean, specified boolean, ensures_calls array<string>")
    got = {r["label"]: (r["matched"], r["failed"]) for r in specs.explained(df, table, stop).collect()}
    assert got == {"data-invariant": (False, ["ensures_calls_contain"]), "functional-correctness": (False, ["mode"]), "memory-safety": (False, ["ensures_calls_empty", "mode"])}
    tracked = spark.createDataFrame([("S::hash(&[u8])", "c::scalar"), ("enc(x)", "c::deep"), ("gone", "c::x")], "function string, module string")
    atoms = spark.createDataFrame([("S::hash", "probe:c/1/scalar/S#hash()", "scalar"), ("hash", "probe:c/1/a/hash()", "a"), ("enc", "probe:c/1/other/deep_enc()", "other")], "display_name string, code_name string, code_module string")
    assert {r["function"]: r["code_name"] for r in specs.match_tracked(tracked, atoms).collect()} == {"S::hash(&[u8])": "probe:c/1/scalar/S#hash()", "enc(x)": "probe:c/1/other/deep_enc()", "gone": None}


def test_small_readers(spark, tmp_path):
    (tmp_path / "s").mkdir()
    (tmp_path / "s" / "one.md").write_text('---\ncode-line: 12\ncode-path: "src/a.rs"\n---\ntext')
    (tmp_path / "s" / "two.md").write_text("no front matter")
    got = {r["stub"]: r for r in documents.read_stubs(spark, str(tmp_path / "s")).collect()}
    assert (got["one.md"]["code_line"], got["one.md"]["code_path"], got["one.md"]["code_name"], got["two.md"]["ok"]) == (12, "src/a.rs", None, False)
    (tmp_path / "e.json").write_text('{"focus_functions": [{"display_name": "f", "relative_path": "p/src/a.rs"}]}')
    assert {tuple(r) for r in documents.read_entrypoints(spark, str(tmp_path / "e.json")).collect()} == {("f", "p/src/a.rs"), ("f", "src/a.rs")}
    (tmp_path / "t.csv").write_text('function,module,impl_block\nf,m,"A<B, C>"\n')
    assert documents.read_tracked(spark, str(tmp_path / "t.csv")).first()["impl_block"] == "A<B, C>"


def test_lines_end_at_line_feeds_alone():
    source = "// a\x0c page\u2028break\r\nfn a()\n    requires x > 0,\n{}\nfn b() {}\n"
    a, b = Source(source).functions()
    assert (a["lines_start"], a["lines_end"], a["requires_text"], a["signature_text"]) == (2, 4, "requires x > 0,", "fn a()\nrequires x > 0,") and b["lines_start"] == 5


def test_only_item_macros_hold_functions():
    source = "verus! { fn a() {} }\ncfg_if! { if #[cfg(x)] { fn b() {} } else { fn c() {} } }\nmacro_rules! m { () => { fn d() {} } }\nfoo! { fn e() {} }\nfn f() { if !(x) { } }\nx::verus! { fn g() {} }\nfn h() {}\n"
    assert [f["name"] for f in Source(source).functions()] == ["a", "b", "c", "f", "h"]


def test_numbers_too_large_are_zero(spark):
    (m,) = told(spark, "error: bad\n --> a.rs:99999999999999999999:3\n\n")
    assert (m["line_number"], m["column"]) == (0, 3)


def test_atoms_match_by_whole_source_paths(spark):
    functions = spark.createDataFrame([("new", "p/src/x/src/y.rs", 10, 20), ("new", "q/src/y.rs", 10, 20), ("new", "y.rs", 40, 90)], "name string, file string, lines_start long, lines_end long")
    atoms = spark.createDataFrame([("T::new", "k1", "z/src/y.rs", 12), ("T::new", "k2", "w/src/x/src/y.rs", 11), ("new", "k3", "b/y.rs", 60)], "display_name string, code_name string, code_path string, lines_start long")
    got = {(r["file"], r["code_name"]) for r in verifylog.match_atoms(functions, atoms).collect()}
    assert got == {("p/src/x/src/y.rs", "k2"), ("q/src/y.rs", "k1"), ("y.rs", "k3")}
    assert {r["code_name"] for r in verifylog.match_atoms(functions, atoms, use_span=False).collect()} == {"k1", "k2"}


def test_needles_of_all_forms_are_found(spark):
    texts = spark.createDataFrame([(1, "the xabc def ghi  jkl"), (2, "abc def"), (3, None), (None, "zz abc def ghix"), (4, ""), (4, "(f(x) q")], "k int, t string")
    needles = spark.createDataFrame([(1, "abc def ghi"), (2, "c d"), (3, "f("), (4, ""), (5, " "), (6, "b"), (7, "i  j")], "n int, s string")
    expected = sorted(str((r["k"], m["n"])) for r in texts.collect() for m in needles.collect() if m["s"] and m["s"] in (r["t"] or ""))
    assert sorted(str(tuple(r)) for r in joins.contained(texts, "k", "t", needles, "n", "s").collect()) == expected


def test_equal_points_are_answered_each(spark):
    points, spans = spark.createDataFrame([(1, 5), (1, 5), (1, 50)], "k int, p int"), spark.createDataFrame([(1, 0, 9, "a"), (1, 4, 6, "b")], "k int, s int, e int, name string")
    assert [r["name"] for r in joins.innermost(points, spans, ["k"], "p", "s", "e").collect()] == ["b", "b"]
