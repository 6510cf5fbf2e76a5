"""Reachability along edges."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from atomweave.operators.cut import cut

#: Frontiers that are kept apart before they're written as one.
PARTS = 8


#: Rounds after which chains are worth shortening.
PATIENCE = 6


def shortcuts(edges: DataFrame) -> DataFrame:
    """(src, dst): from each node that leads to one other alone, the nodes 2, 4, 8, ... steps on along such nodes.

    Each round doubles the steps; rounds are as many as the logarithm of the longest chain, or of all nodes in a cycle."""
    hop = cut(edges.groupBy("src").agg(F.count("*").alias("n"), F.min("dst").alias("dst")).where("n = 1").select("src", "dst"))
    made, most, steps = [], hop.count(), 1
    while steps < most:
        further = hop.select(F.col("src").alias("dst"), F.col("dst").alias("end"))
        hop = cut(hop.join(further, "dst").select("src", F.col("end").alias("dst")))
        if hop.isEmpty():
            break
        made.append(hop)
        steps *= 2
    return reduce(DataFrame.union, made).where("src <> dst").distinct() if made else edges.limit(0)


def reachable(seeds: DataFrame, edges: DataFrame) -> DataFrame:
    """(id): all that the seeds (id) lead to along edges (src, dst), themselves included; cycles are fine.

    Semi-naive: each round expands only what the round before found, and writes only what is new.  If that takes long, long
    chains get shortcuts: what is d steps on along a chain is then as many rounds away as d has binary ones."""
    edges = cut(edges.select("src", "dst").where("src <> dst").distinct())
    frontier = cut(seeds.select("id").where(F.col("id").isNotNull()).distinct())
    parts, rounds = [frontier], 0
    while True:
        seen = reduce(DataFrame.union, parts)
        frontier = cut(edges.join(frontier, edges["src"] == frontier["id"], "left_semi").select(F.col("dst").alias("id")).distinct().join(seen, "id", "left_anti"))
        if frontier.isEmpty():
            return seen
        parts.append(frontier)
        rounds += 1
        if rounds == PATIENCE:
            edges = cut(edges.union(shortcuts(edges)).distinct())
            frontier = reduce(DataFrame.union, parts)  # what was found before has shortcuts too
        if len(parts) > PARTS:
            parts = [cut(reduce(DataFrame.union, parts))]
