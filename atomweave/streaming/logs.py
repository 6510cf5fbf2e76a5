"""Logs as they arrive: each micro-batch of files is worked on by the same operators as a batch of logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from atomweave.plans import verifylog


def stream_logs(spark: SparkSession, folder: str) -> DataFrame:
    """(log_id, text) of files that appear in ``folder``; a log is whole in its file, so no state spans batches."""
    rows = spark.readStream.option("wholetext", True).text(folder)
    return rows.select(F.col("_metadata.file_name").alias("log_id"), F.col("value").alias("text"))


def stream_failures(spark: SparkSession, folder: str, out: str, checkpoint: str) -> StreamingQuery:
    """Append the failures of arriving logs to Parquet at ``out``.  A batch that is run again overwrites its own files."""

    def write(batch: DataFrame, number: int) -> None:
        verifylog.failures(verifylog.log_lines(batch)).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return stream_logs(spark, folder).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
