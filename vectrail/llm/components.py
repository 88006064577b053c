"""Connected components of a graph whose nodes are of any type that has an order, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vectrail.llm import common


def _large(edges: DataFrame) -> DataFrame:
    """Each neighbour above a node moves to the least node around."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small(edges: DataFrame) -> DataFrame:
    """Each node and its neighbours below move to the least of those. Edges are (a, b) with a > b."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """node, component (the least node reachable), for every node that has an edge to another, other than least nodes.

    Each round's edges go to the shared folder and the round before is removed. A round that leaves the
    edges as they were ends the search; the number of rounds follows the logarithm of the longest path.
    """
    spark = edges.sparkSession
    lower = edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b"))
    path = common.written(lower.distinct(), "edges")
    seen = None
    for _ in range(rounds):
        new = common.written(_small(_large(common.reread(spark, path))), "edges")
        common.dropped(spark, path)
        path = new
        mark = common.reread(spark, path).agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == seen:
            return common.reread(spark, path).select(F.col("a").alias("node"), F.col("b").alias("component"))
        seen = mark
    raise RuntimeError("components did not settle")
