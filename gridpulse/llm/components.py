"""Connected components by alternating large and small stars, with edges kept in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridpulse.llm.spark import stored


def _unsettled(edges: DataFrame) -> bool:
    """Whether some node has two edges, or has one and is the end of another: the edges are no stars yet."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("up")).unionByName(edges.select(F.col("v").alias("x"), F.lit(0).alias("up")))
    seen = ends.groupBy("x").agg(F.sum("up").alias("ups"), F.min("up").alias("least"))
    return bool(seen.where("ups > 1 or (ups = 1 and least = 0)").take(1))


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` (the smallest node reached) of every node that has an edge ``u, v``.

    No step gathers a node's neighbours: each takes a minimum per node and joins it back to the edges.
    """
    edges = stored(
        edges.where(F.col("u") != F.col("v"))
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .distinct()
    )
    while _unsettled(edges):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        hung = large.join(least, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = hung.unionByName(least.select("u", F.col("m").alias("v"))).where(F.col("u") != F.col("v"))
        edges = stored(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    roots = edges.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    leaves = edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))
    return leaves.unionByName(roots.join(leaves.select("node"), "node", "left_anti"))
