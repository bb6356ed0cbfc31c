"""As-of join: every row meets the latest earlier row of its key, without pairs."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A reading without a time is of now, one to be met without a time is older than all others.
NOW, LONG_AGO = datetime(9999, 12, 31), datetime(1, 1, 1)


def as_of_join(
    left: DataFrame, right: DataFrame, keys, left_time: Column, right_time: Column, values, prefix: str = "was_", how: str = "inner", slice_unit: str = "month"
) -> DataFrame:
    """The rows of ``left`` with ``<prefix><value>`` of the latest row of ``right`` of the same key, not after them in time.

    Both sides are put into one sequence per key, cut into time slices. Inside a slice the
    last row of ``right`` so far is carried along; the last one of a slice is found by a
    map-side aggregate and goes to the slices after it. No pairs are made, and a key with very many rows is
    spread over as many tasks as it has slices. Of rows of ``right`` with equal key and
    time, the greatest values count. With ``how="left"`` rows without an earlier one stay.
    """
    keys, values = list(keys), list(values)
    met = F.struct(*[F.col(v) for v in values])
    rows = left.select(
        *keys, F.coalesce(left_time, F.lit(NOW)).cast("timestamp").alias("_at"), F.lit(1).alias("_side"), F.struct(*left.columns).alias("_row")
    )
    others = right.select(*keys, F.coalesce(right_time, F.lit(LONG_AGO)).cast("timestamp").alias("_at"), F.lit(0).alias("_side"), met.alias("_met"))
    both = rows.unionByName(others, allowMissingColumns=True).withColumn("_slice", F.date_trunc(slice_unit, "_at"))
    so_far = Window.partitionBy(*keys, "_slice").orderBy("_at", "_side", "_met").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = both.withColumn("_found", F.last("_met", ignorenulls=True).over(so_far)).where("_side = 1")
    last = both.groupBy(*keys, "_slice").agg(F.max(F.when(F.col("_side") == 0, F.struct("_at", "_met"))).alias("_last"))
    before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = last.select(*keys, "_slice", F.last("_last", ignorenulls=True).over(before).alias("_carry"))
    joined = inside.join(carried, [*keys, "_slice"]).withColumn("_was", F.coalesce("_found", F.col("_carry._met")))
    if how == "inner":
        joined = joined.where(F.col("_was").isNotNull())
    return joined.select(
        *[F.col(f"_row.`{c}`").alias(c) for c in left.columns], *[F.col(f"_was.`{v}`").alias(f"{prefix}{v}") for v in values]
    )


def time_of(df: DataFrame, *names: str) -> Column:
    """The first of these columns that the table has and that is not null; null if it has none."""
    return F.coalesce(*[F.col(n) for n in names if n in df.columns], F.lit(None).cast("timestamp"))
