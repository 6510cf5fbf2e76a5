"""Results as files.  Tables are written as Parquet; the dictionary forms exist for readers of the JSON documents."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _bare(name: str) -> str:
    return name.replace("_", "-")


def document(*columns: Column) -> Column:
    """A JSON object of columns, without nulls and empty lists."""
    return F.to_json(F.struct(*columns))


def dictionary(df: DataFrame, key: str, columns: list[str], spans: bool = True) -> DataFrame:
    """One row ``value``: the JSON object of all rows by key, sorted by key; lines go into ``code-text``."""
    own = [F.col(c).alias(_bare(c)) for c in columns if not (spans and c in ("lines_start", "lines_end"))]
    if spans and "lines_start" in columns:
        own.append(F.struct(F.col("lines_start").alias("lines-start"), F.col("lines_end").alias("lines-end")).alias("code-text"))
    entries = F.array_sort(F.collect_list(F.struct(F.col(key).alias("k"), F.to_json(F.struct(*own)).alias("v"))))
    text = F.concat(F.lit("{"), F.array_join(F.transform(entries, lambda e: F.concat(F.to_json(F.struct(e["k"].alias("k"))).substr(F.lit(6), F.length(F.to_json(F.struct(e["k"].alias("k")))) - 6), F.lit(":"), e["v"])), ",\n"), F.lit("}"))
    return df.agg(text.alias("value"))


def write_text(df: DataFrame, path: str) -> None:
    """The single row of ``df`` as a file on the driver."""
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text((df.first() or [""])[0] or "{}")


def write_json(value: object, path: str) -> None:
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(json.dumps(value, indent=2))


def csv_lines(df: DataFrame, quoted: bool = True) -> DataFrame:
    """``df`` as CSV lines under ``value``; without ``quoted`` values are joined by commas as they are."""
    safe = lambda c: F.when(F.col(c).rlike('[",\n]'), F.concat(F.lit('"'), F.replace(F.col(c), F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(F.col(c))
    return df.select(F.concat_ws(",", *[safe(c) if quoted else F.col(c) for c in df.columns]).alias("value"))


def write_cache(folder: str, project: str, package: str | None, exit_code: int, text: str) -> None:
    """The output of a verifier run with what it was run on, for a later analysis."""
    write_json({"project_path": project, "package": package, "exit_code": exit_code}, f"{folder}/verification_config.json")
    Path(folder, "verification_output.txt").write_text(text)


def read_cache(folder: str) -> tuple[str, int, str]:
    """(project, exit code, path of the output) of the run kept last."""
    config = json.loads(Path(folder, "verification_config.json").read_text())
    return config["project_path"], config["exit_code"], str(Path(folder, "verification_output.txt"))
