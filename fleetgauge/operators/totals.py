"""Totals per group joined back, in place of a window over the whole group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame


def with_totals(rows: DataFrame, source: DataFrame, keys, totals: dict[str, Column]) -> DataFrame:
    """Join per-key totals of ``source`` to ``rows``.

    The totals combine map side to one row per key, so no task sees a whole group;
    AQE turns the join into a broadcast when the totals turn out small.
    """
    summed = source.groupBy(*keys).agg(*[c.alias(n) for n, c in totals.items()])
    return rows.join(summed, list(keys))
