"""Deterministic top-k, per group and overall."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def top_per(df: DataFrame, keys, order, k: int, rank: str = "rank") -> DataFrame:
    """The k first rows of every group, with their rank.

    Filtering row_number lets Spark put a group limit below the shuffle: each map
    task keeps at most k rows per group, so a group that holds a large part of all
    rows never reaches one reducer whole. The order must end in a unique key.
    """
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).where(F.col(rank) <= k)


def top_overall(df: DataFrame, order, k: int) -> DataFrame:
    """The k first rows of the whole frame (planned as TakeOrderedAndProject)."""
    return df.orderBy(*order).limit(k)
