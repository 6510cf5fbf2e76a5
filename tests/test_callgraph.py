import json

import pytest
from pyspark.sql import functions as F

from atomweave.functions import paths, symbols
from atomweave.functions.text import clauses
from atomweave.plans import callgraph
from atomweave.sources.index import read_index

P = "rust-analyzer cargo c 1.0.0 "
Q = "rust-analyzer cargo curve25519-dalek 4.1.3 "


def one(spark, **values):
    """A function that evaluates expressions over one row of strings."""
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return lambda c: row.select(c.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("symbol", "base", "expected"),
    [
        (Q + "edwards/CompressedEdwardsY#ConstantTimeEq<&CompressedEdwardsY>#ct_eq().", "ct_eq", "CompressedEdwardsY::ct_eq"),
        (Q + "edwards/&CompressedEdwardsY#CompressedEdwardsY<Option<EdwardsPoint>>#decompress().", "decompress", "CompressedEdwardsY::decompress"),
        (Q + "ristretto_specs/specs/spec_ristretto_decompress().", "spec_ristretto_decompress", "spec_ristretto_decompress"),
        ("short symbol", "something", "something"),
        ("other-tool cargo crate 1.0 module/Type#method().", "method", "Type::method"),
    ],
)
def test_display_name(spark, symbol, base, expected):
    assert one(spark, s=symbol, b=base)(symbols.display_name(F.col("s"), F.col("b"))) == expected


@pytest.mark.parametrize(
    ("path", "signature", "own", "line", "target", "expected"),
    [
        ("montgomery/Mul#mul().", "fn mul(self, scalar: &Scalar) -> MontgomeryPoint", "&MontgomeryPoint", None, None, "montgomery/&MontgomeryPoint#Mul<&Scalar>#mul()"),
        ("window/NafLookupTable5#From#from().", "fn from(A: &EdwardsPoint) -> Self", None, None, "ProjectiveNielsPoint", "window/NafLookupTable5<ProjectiveNielsPoint>#From<&EdwardsPoint>#from()"),
        ("window/NafLookupTable5#From#from().", "fn from(A: &EdwardsPoint) -> Self", None, "345", None, "window/NafLookupTable5#From<&EdwardsPoint>#from()@345"),
        ("m/into_it().", "fn into_it(self) -> &'a mut Out", None, None, None, "m/into_it()"),
    ],
)
def test_code_name(spark, path, signature, own, line, target, expected):
    name = path.rsplit("#")[-1].rsplit("/")[-1].split("(")[0]
    ev = one(spark, s=Q + path, d=name, g=signature, o=own, l=line, t=target)
    assert ev(symbols.code_name(*[F.col(c) for c in "sdgolt"])) == "probe:curve25519-dalek/4.1.3/" + expected


def test_unknown_symbols_keep_their_text(spark):
    ev = one(spark, s=P + "a/thing!", d="thing")
    assert ev(symbols.code_name(F.col("s"), F.col("d"), F.lit(None).cast("string"), F.lit(None).cast("string"))) == "probe:c/1.0.0/a/thing!"


def test_small_names(spark):
    ev = one(spark, m="probe:curve25519-dalek/4.1.3/montgomery/MontgomeryPoint#ct_eq()", n="probe:crate/0.1.0/TopLevel#method()", s="self: &'a MontgomeryPoint", p="a/src/specs/field_specs.rs")
    assert ev(symbols.code_module(F.col("m"))) == "montgomery"
    assert ev(symbols.code_module(F.col("n"))) == ""
    assert ev(symbols.self_type(F.col("s"))) == "&MontgomeryPoint"
    assert ev(paths.module_path(F.col("p"))) == "specs::field_specs"
    assert ev(paths.short_module(F.lit("specs::field_specs"))) == "field"
    assert ev(paths.sub_module(F.lit("backend::serial::u64::scalar"))) == "u64"
    assert ev(paths.module_path(F.lit("src/lib.rs"))) == ""
    assert ev(paths.entry_id(F.lit("specs::field_specs"), F.lit("foo"), F.lit("foo"))) == "specs__field_specs__foo"
    assert ev(paths.entry_id(F.lit(""), F.lit("from"), F.lit("LookupTable<X>::from"))) == "lookuptable_x__from"
    assert [ev(paths.score(F.lit(a), F.lit("src/lib.rs"))) for a in ("src/lib.rs", "/project/src/lib.rs", "/other/lib.rs", "/other/main.rs")] == [3, 2, 1, 0]
    assert ev(clauses(F.lit("\n        x > 0 && y > 0,\n\n"))) == ["x > 0 && y > 0,"]


def symbol(name, text="fn f()", kind=17, **more):
    return {"symbol": P + name, "kind": kind, "display_name": name.rstrip("().").rsplit("/")[-1].rsplit("#")[-1], "signature_documentation": {"language": "rust", "text": text, "position_encoding": 1}, **more}


def occurrence(at, name, roles=None):
    return {"range": at, "symbol": P + name, **({} if roles is None else {"symbol_roles": roles})}


def write(tmp_path, documents):
    docs = [{"language": "rust", "relative_path": p, "position_encoding": 1, "occurrences": o, "symbols": s} for p, o, s in documents]
    path = tmp_path / "index.json"
    path.write_text(json.dumps({"metadata": {"tool_info": {"name": "t", "version": "1"}, "project_root": "/", "text_document_encoding": 1}, "documents": docs}))
    return str(path)


def test_mini_call_graph(spark, tmp_path):
    occ = [occurrence([0, 3, 6], "a/foo().", 1), occurrence([1, 4, 7], "a/bar()."), occurrence([2, 4, 7], "a/foo()."), occurrence([10, 3, 6], "a/bar().", 1), occurrence([11, 4, 7], "ext/baz().")]
    s, o = read_index(spark, write(tmp_path, [("src/a.rs", occ, [symbol("a/foo()."), symbol("a/bar()."), symbol("ext/baz().")])]))
    rows = {r["code_name"]: r for r in callgraph.atoms(s, o, with_locations=True).collect()}
    assert set(rows) == {"probe:c/1.0.0/a/foo()", "probe:c/1.0.0/a/bar()"}
    assert rows["probe:c/1.0.0/a/foo()"]["dependencies"] == ["probe:c/1.0.0/a/bar()"]
    assert rows["probe:c/1.0.0/a/bar()"]["dependencies"] == ["probe:c/1.0.0/ext/baz()"]
    assert [(d["location"], d["line"]) for d in rows["probe:c/1.0.0/a/bar()"]["dependencies_with_locations"]] == [("inner", 12)]
    assert (rows["probe:c/1.0.0/a/bar()"]["lines_start"], rows["probe:c/1.0.0/a/bar()"]["lines_end"], rows["probe:c/1.0.0/a/bar()"]["code_module"]) == (11, 11, "a")
    assert callgraph.duplicate_names(callgraph.atoms(s, o)).isEmpty()


def test_alike_implementations_and_hints(spark, tmp_path):
    name, sig = "w/Table#From#from().", "fn from(A: &Point) -> Self"
    occ = [
        occurrence([4, 0, 3], "t/Niels#"), occurrence([5, 3, 6], name, 1), occurrence([20, 0, 3], "t/Affine#"), occurrence([21, 3, 6], name, 1),
        occurrence([40, 3, 6], "w/use_it().", 1), occurrence([41, 0, 3], "t/Niels#"), occurrence([41, 5, 8], name), occurrence([50, 3, 6], "w/use_any().", 1), occurrence([51, 5, 8], name),
    ]
    s, o = read_index(spark, write(tmp_path, [("src/w.rs", occ, [symbol(name, sig), symbol(name, sig), symbol("w/use_it()."), symbol("w/use_any().")])]))
    rows = {r["display_name"] + str(r["lines_start"]): r for r in callgraph.atoms(s, o).collect()}
    niels, affine = (f"probe:c/1.0.0/w/Table<{t}>#From<&Point>#from()" for t in ("Niels", "Affine"))
    assert {rows["Table::from6"]["code_name"], rows["Table::from22"]["code_name"]} == {niels, affine}
    assert rows["use_it41"]["dependencies"] == [niels]
    assert rows["use_any51"]["dependencies"] == sorted([niels, affine])


def test_self_types_are_told_apart(spark, tmp_path):
    name, sig = "m/Mul#mul().", "fn mul(self, s: &Scalar) -> Out"
    more = [symbol(name, sig), symbol(name, sig)] + [symbol("m/self.", t, kind=1, enclosing_symbol=P + name) for t in ("self: &Point", "self: Point")]
    for x in more[2:]:
        x["display_name"] = "self"
    s, o = read_index(spark, write(tmp_path, [("src/m.rs", [occurrence([5, 1, 2], name, 1), occurrence([9, 1, 2], name, 1)], more)]))
    assert {r["code_name"] for r in callgraph.atoms(s, o).collect()} == {"probe:c/1.0.0/m/&Point#Mul<&Scalar>#mul()", "probe:c/1.0.0/m/Point#Mul<&Scalar>#mul()"}


def test_a_missing_field_is_an_error(spark, tmp_path):
    bad = symbol("a/foo().")
    del bad["signature_documentation"]
    with pytest.raises(ValueError, match="mandatory"):
        read_index(spark, write(tmp_path, [("src/a.rs", [], [bad])]))
