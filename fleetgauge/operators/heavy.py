"""Frequent values in bounded memory: one counter summary for each task, then one exact count."""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def trimmed(counts: Counter, size: int) -> Counter:
    """At most ``size`` counters: the largest one that has to go is taken off all."""
    if len(counts) <= size:
        return counts
    off = sorted(counts.values(), reverse=True)[size]
    return Counter({v: n - off for v, n in counts.items() if n > off})


def summaries(values: DataFrame, size: int) -> DataFrame:
    """column_name, value, counter of every task's summary; values (column_name, value) are strings."""

    def count(batches):
        held: dict[str, Counter] = {}
        for batch in batches:
            fresh = pa.Table.from_batches([batch]).group_by(["column_name", "value"]).aggregate([([], "count_all")]).to_pydict()
            for name, value, n in zip(fresh["column_name"], fresh["value"], fresh["count_all"]):
                held.setdefault(name, Counter())[value] += n
            held = {name: trimmed(own, size) for name, own in held.items()}
        rows = [(name, value, n) for name, own in held.items() for value, n in own.items()]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.int64())],
            names=["column_name", "value", "counter"],
        )

    return values.mapInArrow(count, "column_name string, value string, counter bigint")


def heavy_values(values: DataFrame, share: float) -> DataFrame:
    """column_name, value, rows, total of the values that hold more than ``share`` of the non-null rows of their column.

    A summary keeps K = ceil(2 / share) counters. Taking c off all counters takes c off more
    than K of them, so that a task with n rows does so for n / K in all at most: a value's
    counter falls short of its rows there by n / K <= n share / 2, and over all tasks of N
    rows by N share / 2. So a value with more than N share rows has counters that add up to
    more than N share / 2, whatever the order of the rows. As all counters add up to N at
    most, fewer than 2 / share values of a column do so: these few are counted exactly in
    a second pass, and the others go.
    """
    if not 0 < share < 1:
        raise ValueError(f"a share lies between 0 and 1, not {share}")
    present = values.where(F.col("value").isNotNull())
    totals = present.groupBy("column_name").agg(F.count("*").alias("total"))
    size = -int(-2 // share)
    candidates = (
        summaries(present, size).groupBy("column_name", "value").agg(F.sum("counter").alias("counters"))
        .join(F.broadcast(totals), "column_name")  # a row for each column
        .where(F.col("counters") > F.col("total") * share / 2)
        .select("column_name", "value", "total")
    )
    exact = present.join(F.broadcast(candidates), ["column_name", "value"])  # fewer than 2 / share rows for each column
    return (
        exact.groupBy("column_name", "value").agg(F.count("*").alias("rows"), F.first("total").alias("total"))
        .where(F.col("rows") > F.col("total") * share)
    )
