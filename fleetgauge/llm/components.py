"""Connected components by alternating stars, on DataFrames of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetgauge.llm.common import saved


def _mark(edges: DataFrame) -> tuple:
    """Count and order-free checksum of an edge table: two scalars tell whether a round changed it."""
    h = F.xxhash64("a", "b")
    return tuple(edges.agg(F.count("*"), F.sum(h.cast("decimal(38,0)"))).first())


def components(links: DataFrame, left: str, right: str) -> DataFrame:
    """`node`, `root`: every node of a link and the smallest node it can reach.

    Each round joins every node to the smallest of its neighbours (large star), then the
    smaller neighbours of a node to the smallest of them (small star). Both are a grouped
    minimum, which pre-aggregates before its shuffle, and an equi-join, whose hot keys
    Spark splits; no neighbour list is ever gathered. The rounds grow with the logarithm
    of the longest path. A round ends in a table in the shared folder. Links with a null
    end, and those from a node to itself, are not used.
    """
    edges = saved(
        links.select(F.greatest(left, right).alias("a"), F.least(left, right).alias("b"))
        .where(F.col(left).isNotNull() & F.col(right).isNotNull() & (F.col(left) != F.col(right))).distinct(),
        "links",
    )
    mark = _mark(edges)
    while mark[0]:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).where("a != b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(low, "a").select("b", "low").where("b != low").select(F.col("b").alias("a"), F.col("low").alias("b"))
        edges = saved(small.union(low.select("a", F.col("low").alias("b"))).distinct(), "stars")
        before, mark = mark, _mark(edges)
        if before == mark:
            break
    rooted = edges.groupBy("a").agg(F.min("b").alias("root")).withColumnRenamed("a", "node")
    return rooted.union(rooted.select("root", "root").distinct())
