"""Connected components of a graph given as edges, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def _large(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is hung on the node's least neighbour."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.where(F.col("v") > F.col("u")).join(least, "u").select(F.col("m").alias("u"), "v").where(F.col("u") != F.col("v")).distinct()


def _small(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are hung on the least of them. Edges have u < v."""
    least = edges.groupBy("v").agg(F.min("u").alias("m"))
    hung = edges.join(least, "v").where(F.col("u") != F.col("m")).select(F.col("m").alias("u"), F.col("u").alias("v"))
    return hung.unionByName(least.select(F.col("m").alias("u"), "v")).distinct()


def components(edges: DataFrame, scratch: Scratch, max_rounds: int = 60) -> DataFrame:
    """(node, least): every node of an edge with the least node that it can reach.

    edges has u and v of one ordered type; direction, repeats and loops don't matter. Each round writes its edges, which
    never outnumber the given ones by much, and the last round's are stars. Only one count a round comes to the driver.
    """
    now = scratch.cut(edges.where(F.col("u") != F.col("v")).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())
    mark = None
    for _ in range(max_rounds):
        new = scratch.cut(_small(_large(now)))
        seen = new.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        scratch.drop(now)
        now = new
        if seen == mark:
            break
        mark = seen
    else:
        raise RuntimeError(f"components haven't settled after {max_rounds} rounds")
    return now.select(F.col("v").alias("node"), F.col("u").alias("least")).unionByName(now.select(F.col("u").alias("node"), F.col("u").alias("least")).distinct())
