"""Small inputs: rule files, stub markdown, entry points, tracked functions, logs."""

from __future__ import annotations

import tomllib

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from atomweave.operators.rules import CRITERIA, RULE_SCHEMA

FRONT_MATTER = r"(?s)^---(.*?)\n---"


def read_rules(spark: SparkSession, path: str) -> tuple[DataFrame, list[str]]:
    """The rules of a TOML file in order, and its stop words."""
    with open(path, "rb") as f:
        spec = tomllib.load(f)
    rows = [(i, r["label"], r.get("description", ""), r.get("trust", ""), *[r.get("match", {}).get(c) for c in CRITERIA]) for i, r in enumerate(spec.get("rules", []))]
    return spark.createDataFrame(rows, RULE_SCHEMA), list(spec.get("stop_words", []))


def read_stubs(spark: SparkSession, path: str) -> DataFrame:
    """(stub, code_line, code_path, code_name) of a markdown tree; ``ok`` is false where the front matter is missing.

    Front matter is flat ``key: value`` lines, read by expression."""
    whole = spark.read.format("text").option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").load(path)
    body = F.when(F.col("value").rlike(FRONT_MATTER), F.regexp_extract("value", FRONT_MATTER, 1))
    value = lambda key: F.nullif(F.regexp_replace(F.regexp_extract(body, rf"(?m)^{key}:[ \t]*(.*?)[ \t\r]*$", 1), r"""^["']|["']$""", ""), F.lit(""))
    name = F.regexp_replace(F.col("_metadata.file_path"), f"^.*{path.rstrip('/')}/", "")
    return whole.select(name.alias("stub"), value("code-line").try_cast("long").alias("code_line"), value("code-path").alias("code_path"), value("code-name").alias("code_name"), body.isNotNull().alias("ok"))


def read_entrypoints(spark: SparkSession, path: str) -> DataFrame:
    """Distinct (name, path) of the focus functions, each with its path as given and from /src/ on."""
    rows = spark.read.schema("focus_functions array<struct<display_name: string, relative_path: string>>").option("multiLine", True).json(path).select(F.inline("focus_functions"))
    inner = F.when(F.contains("relative_path", F.lit("/src/")), F.regexp_extract("relative_path", "/(src/.*)$", 1))
    return rows.select(F.col("display_name").alias("name"), F.explode(F.array("relative_path", inner)).alias("path")).where("path IS NOT NULL").distinct()


def read_tracked(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("function string, module string, impl_block string").option("header", True).option("quote", '"').option("escape", '"').csv(path)


def read_logs(spark: SparkSession, path: str, exit_code: int = 0) -> DataFrame:
    """(log_id, text, exit_code): a log for each file."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("log_id"), F.col("value").alias("text"), F.lit(exit_code).alias("exit_code"))


def read_pieces(spark: SparkSession, path: str, end: str) -> DataFrame:
    """(file, name, pos, piece): what stands between ``end``s in files of any size, numbered from 1 within each file.

    Files are read in splits, each piece by the split in which it begins.  A piece's number is its place in its split and the
    pieces of the splits before, of which there is one short row each."""
    read = spark.read.option("lineSep", end).text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_name").alias("name"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("at"), F.col("value").alias("piece"))
    # within a split the running number goes up by one from piece to piece
    splits = read.groupBy("file", "start").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    before = F.sum("n").over(Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1))
    begins = splits.select("file", "start", "first", F.coalesce(before, F.lit(0)).alias("before"))
    return read.join(begins, ["file", "start"]).select("file", "name", (F.col("at") - F.col("first") + F.col("before") + 1).alias("pos"), "piece")


def read_log_lines(spark: SparkSession, path: str) -> DataFrame:
    """(log_id, pos, line): the lines of logs of any size.  Lines end at line feeds; a carriage return before one is no part of
    the line."""
    return read_pieces(spark, path, "\n").select(F.col("name").alias("log_id"), "pos", F.regexp_replace("piece", "\r$", "").alias("line"))
