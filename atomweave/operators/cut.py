"""Lineage cut at tables in the folder that all executors share, and small tables sent to all."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows that a side of a join may have to be sent to all tasks.
BROADCAST_ROWS = 500_000


def cut(df: DataFrame) -> DataFrame:
    """``df`` with its lineage cut at a checkpoint in the shared folder (a temporary one only where none is set and the
    executors are in this process)."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="spark-"))
    return df.checkpoint()


def small(df: DataFrame) -> DataFrame:
    """``df``, sent to all tasks unless it has more than BROADCAST_ROWS rows."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df
