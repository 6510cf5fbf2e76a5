"""Code indexes (JSON) as tables of symbols and occurrences, and dictionaries of atoms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from atomweave.functions import symbols as sym
from atomweave.operators import scan
from atomweave.operators.cut import cut
from atomweave.sources.documents import read_pieces

INDEX_SCHEMA = """metadata struct<tool_info: struct<name: string, version: string>, project_root: string, text_document_encoding: int>,
    documents array<struct<language: string, relative_path: string, position_encoding: int,
        occurrences: array<struct<range: array<int>, symbol: string, symbol_roles: int>>,
        symbols: array<struct<symbol: string, kind: int, display_name: string, documentation: array<string>, enclosing_symbol: string,
            signature_documentation: struct<language: string, text: string, position_encoding: int>>>>>"""

ATOM_TYPE = """map<string, struct<`display-name`: string, dependencies: array<string>, `dependencies-with-locations`: array<struct<`code-name`: string, location: string, line: bigint>>,
    `code-module`: string, `code-path`: string, `code-text`: struct<`lines-start`: bigint, `lines-end`: bigint>, mode: string>>"""


#: Pieces of an index that one task looks at.
PIECE = 100_000


def split_documents(spark: SparkSession, path: str) -> DataFrame:
    """(index, doc_pos, text): the documents of indexes of any size as JSON, read in splits.

    An index is cut at its opening braces.  Whether a piece begins within a string, and how deep, follows from the quotes and
    brackets of all before it: each piece tells what it adds for either case, and running sums over blocks of pieces settle
    which holds.  A document is an object that is an entry of a list of the outermost object and has a path."""
    pieces = read_pieces(spark, path, "{")
    plain = F.regexp_replace("piece", r"(?s)\\.", "")
    bare = lambda begins: F.regexp_replace(F.concat(F.lit(begins), plain), r'"[^"]*("|\z)', "")
    many = lambda text, c: F.length(text) - F.length(F.replace(text, F.lit(c), F.lit("")))
    deeper = lambda text: many(text, "[") - many(text, "]") - many(text, "}")
    last = lambda text: F.nullif(F.regexp_extract(text, r"(\S)\s*\z", 1), F.lit(""))
    out, within = bare(""), bare('"')
    told = cut(pieces.select("file", "pos", many(plain, '"').alias("quotes"), deeper(out).alias("d0"), deeper(within).alias("d1"), last(out).alias("l0"), last(within).alias("l1")))
    key, order = ["file"], ["pos"]
    state = scan.summed(scan.blocked_by_position(told, "pos", PIECE), key, order, F.col("quotes"), "sum")
    inner = (F.col("sum") - F.col("quotes")) % 2 == 1
    own = cut(state.select("file", "pos", "__block", inner.alias("inner"), ((~inner & (F.col("pos") > 1)).cast("int") + F.when(inner, F.col("d1")).otherwise(F.col("d0"))).alias("adds"), F.when(inner, F.col("l1")).otherwise(F.col("l0")).alias("last")))
    deep = scan.summed(own, key, order, F.col("adds"), "depth")
    begins = cut(scan.carried(deep, key, order, F.col("last"), "before", before=True))
    opens = ~F.col("inner") & (F.col("pos") > 1) & (F.col("depth") - F.col("adds") == 2) & F.col("before").isin("[", ",")
    numbered = scan.summed(begins, key, order, opens.cast("int"), "doc").where("doc > 0").select("file", "pos", "doc")
    text = F.concat(F.lit("{"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "piece"))), lambda x: x["piece"]), "{"))
    docs = pieces.join(numbered, ["file", "pos"]).groupBy("file", "doc").agg(text.alias("text"))
    return docs.where(F.get_json_object("text", "$.relative_path").isNotNull()).select(F.col("file").alias("index"), (F.col("doc") - 1).cast("int").alias("doc_pos"), "text")


def read_index(spark: SparkSession, path: str, split: bool = False) -> tuple[DataFrame, DataFrame]:
    """(symbols, occurrences) of one index or a folder of them; array positions become columns, since order has meaning.

    With ``split`` an index is read by many tasks, else by one.  Raises ValueError if a mandatory field is missing, as a
    strict reader would."""
    if split:
        kind = INDEX_SCHEMA[INDEX_SCHEMA.index("array<") + 6 : -1]
        docs = split_documents(spark, path).select("index", "doc_pos", F.from_json("text", kind).alias("d"))
        whole = docs.select(F.lit(True).alias("metadata"), F.lit(True).alias("documents"))
    else:
        whole = spark.read.schema(INDEX_SCHEMA).option("multiLine", True).json(path)
        docs = whole.select(F.col("_metadata.file_path").alias("index"), F.posexplode("documents").alias("doc_pos", "d"))
    at = ["index", "doc_pos", F.regexp_replace("d.relative_path", "^/+", "").alias("path")]
    s = docs.select(*at, F.posexplode("d.symbols").alias("sym_pos", "s")).select(
        "index", "doc_pos", "path", "sym_pos", "s.symbol", "s.kind", "s.display_name", F.col("s.signature_documentation.text").alias("signature"), "s.enclosing_symbol"
    )
    o = docs.select(*at, F.posexplode("d.occurrences").alias("occ_pos", "o")).select(
        "index", "doc_pos", "path", "occ_pos", "o.range", F.get("o.range", F.lit(0)).alias("line"), F.get("o.range", F.lit(1)).alias("col"), "o.symbol", F.col("o.symbol_roles").alias("roles")
    )
    missing = {"documents": whole.where("documents IS NULL OR metadata IS NULL"), "symbols": s.where("symbol IS NULL OR kind IS NULL OR signature IS NULL"), "occurrences": o.where("symbol IS NULL OR range IS NULL")}
    for name, bad in missing.items():
        if not bad.isEmpty():
            raise ValueError(f"{path}: a mandatory field of {name} is missing")
    return s, o


def definitions(occurrences: DataFrame) -> DataFrame:
    return occurrences.where(sym.is_definition(F.col("roles")) & F.col("line").isNotNull())


def type_references(occurrences: DataFrame) -> DataFrame:
    """Where types are mentioned: not defined, with a range, and a symbol ending in #."""
    refs = occurrences.where(~sym.is_definition(F.col("roles")) & F.col("line").isNotNull() & F.endswith("symbol", F.lit("#")))
    return refs.withColumn("type_name", sym.type_name(F.col("symbol"))).where(F.col("type_name").isNotNull())


def read_atoms(spark: SparkSession, path: str) -> DataFrame:
    """(code_name, display_name, code_path, code_module, lines_start, lines_end, mode, dependencies) of an atoms dictionary."""
    rows = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", ATOM_TYPE)).alias("code_name", "a"))
    return rows.select(
        "code_name", F.col("a.display-name").alias("display_name"), F.col("a.code-path").alias("code_path"), F.col("a.code-module").alias("code_module"),
        F.col("a.code-text.lines-start").alias("lines_start"), F.col("a.code-text.lines-end").alias("lines_end"), sym.mode(F.col("a.mode")).alias("mode"), F.col("a.dependencies").alias("dependencies"),
    )
