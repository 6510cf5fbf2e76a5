"""Results that are kept from run to run: only files that changed are read and worked on again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Changed files that are named to the reader; of more, all files are listed and the changed ones picked by a join.
NAMED = 10_000


def files(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """(key, hash) of the files below ``folder``: path, and a hash of size and time of change; contents aren't read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folder)
    return found.select(F.col("path").alias("key"), F.xxhash64("length", "modificationTime").alias("hash"))


def _latest(spark: SparkSession, folder: str) -> DataFrame | None:
    """(key, hash, run) of what was known of each key last; a key that went has no hash."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/manifest")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return None
    rows = spark.read.schema("key string, hash long, run long").parquet(f"{folder}/manifest")
    newest = Window.partitionBy("key").orderBy(F.desc("run"))
    return rows.withColumn("__n", F.row_number().over(newest)).where("__n = 1").drop("__n")


def refresh(units: DataFrame, folder: str, work: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The rows that ``work`` makes of all ``units`` (key, hash), of which only new and changed ones are worked on now.

    ``work`` gets the changed units and returns rows with their key.  A run writes its rows and what it knows of the keys
    that changed beside those of earlier runs; rows count if their run is the last that knew their key.  What a run
    that failed wrote counts for nothing, as its manifest is written last."""
    spark = units.sparkSession
    known = _latest(spark, folder)
    run = 0 if known is None else (known.agg(F.max("run")).first()[0] or 0) + 1
    here = units.select("key", "hash")
    changed = units if known is None else units.join(known.where("hash IS NOT NULL").select("key", "hash"), ["key", "hash"], "left_anti")
    changed = spark.createDataFrame(changed.collect(), units.schema) if changed.limit(NAMED + 1).count() <= NAMED else changed
    work(changed).withColumn("run", F.lit(run).cast("long")).write.mode("overwrite").parquet(f"{folder}/rows/of={run}")
    told = changed.select("key", "hash")
    if known is not None:
        gone = known.where("hash IS NOT NULL").join(here, "key", "left_anti").select("key", F.lit(None).cast("long").alias("hash"))
        told = told.unionByName(gone)
    told.withColumn("run", F.lit(run).cast("long")).write.mode("append").parquet(f"{folder}/manifest")
    return rows(spark, folder)


def rows(spark: SparkSession, folder: str) -> DataFrame:
    """All kept rows that count."""
    known = _latest(spark, folder)
    made = spark.read.option("mergeSchema", False).parquet(f"{folder}/rows")
    return made.join(known.where("hash IS NOT NULL").select("key", "run"), ["key", "run"], "left_semi").drop("run", "of")


def texts(changed: DataFrame) -> DataFrame:
    """(key, text) of changed files; few of them are read by name."""
    spark = changed.sparkSession
    paths = [r["key"] for r in changed.select("key").limit(NAMED + 1).collect()]
    if not paths:
        return spark.createDataFrame([], "key string, text string")
    if len(paths) <= NAMED:
        read = spark.read.option("wholetext", True).text(paths)
        return read.select(F.col("_metadata.file_path").alias("key"), F.col("value").alias("text"))
    found = spark.read.format("binaryFile").load(sorted({p.rsplit("/", 1)[0] for p in paths})).join(changed.select(F.col("key").alias("path")), "path", "left_semi")
    return found.select(F.col("path").alias("key"), F.decode("content", "UTF-8").alias("text"))
