"""Connected components by alternating stars: every round is a group-by and a join, nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keysieve.llm.common import landed


def _round(edges: DataFrame) -> DataFrame:
    """One large star and one small star over edges (a, b) with a > b."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    large = (both.filter(F.col("b") > F.col("a")).join(least, "a")
             .select(F.col("b").alias("a"), F.col("m").alias("b")).filter(F.col("a") != F.col("b"))
             .groupBy("a", "b").agg(F.lit(1).alias("_")).drop("_"))
    large = landed(large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), "star")
    lowest = large.groupBy("a").agg(F.min("b").alias("m"))
    joined = large.join(lowest, "a")
    small = joined.filter(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return small.unionByName(lowest.select("a", F.col("m").alias("b"))).distinct()


def connected_components(edges: DataFrame, most: int = 60) -> DataFrame:
    """(node, root) for every node of edges (a, b): root is the least node of its component.

    Loops, repeated edges and either direction are fine; nodes without another node are left out.
    """
    now = landed(edges.filter(F.col("a") != F.col("b"))
                 .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    mark = None
    for _ in range(most):
        total = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if total == mark:
            return now.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root")).unionByName(
                now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        mark, now = total, landed(_round(now), "edges")
    raise RuntimeError(f"components did not settle in {most} rounds")
