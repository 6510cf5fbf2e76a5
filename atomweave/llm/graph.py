"""Connected components of links, as alternating star contractions over DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from atomweave.llm.common import staged


def _least(edges: DataFrame) -> DataFrame:
    """edges (u, v) with m, the least of each u and its neighbours; sums go before rows, so a hub is no large group."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    return edges.join(least, "u").withColumn("m", F.least("m", "u"))


def components(links: DataFrame) -> DataFrame:
    """(id, component) for all ids of ``links`` (x, y): the least id that links lead to.  Links to oneself count as none.

    Every round hangs larger neighbours, then smaller ones, onto the least id in sight; rounds grow with the logarithm
    of the longest chain.  Each round's edges are written to the shared folder."""
    edges = staged(links.select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")).where("u <> v").distinct())
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _least(both).where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = _least(large)
        small = down.select("u", F.col("m").alias("v")).unionByName(down.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")))
        edges = staged(small.distinct())
        now = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if now == state:
            break
        state = now
    tree = edges.groupBy("u").agg(F.min("v").alias("v"))
    roots = tree.select(F.col("v").alias("u"), "v").distinct()
    return tree.unionByName(roots).groupBy(F.col("u").alias("id")).agg(F.min("v").alias("component"))
