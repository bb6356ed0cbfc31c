"""The previous row of a series, without putting a whole series into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_previous(df: DataFrame, keys, order, bucket: Column, values) -> DataFrame:
    """Add ``prev_<value>`` columns: the values of the preceding row of the same key.

    ``bucket`` cuts each series into consecutive time slices (it must not decrease
    along ``order``). lag() runs inside a slice; the last row of every slice, found
    by a map-side aggregate, is carried into the next one. A key with very many rows
    is thus spread over as many tasks as it has slices.
    """
    keys, order, values = list(keys), list(order), list(values)
    cut = df.withColumn("_slice", bucket)
    inside = Window.partitionBy(*keys, "_slice").orderBy(*order)
    rows = cut.withColumns(
        {
            **{f"_in_{v}": F.lag(v).over(inside) for v in values},
            "_first": F.row_number().over(inside) == 1,
        }
    )
    last = cut.groupBy(*keys, "_slice").agg(
        F.max_by(F.struct(*values), F.struct(*order)).alias("_last")
    )
    across = Window.partitionBy(*keys).orderBy("_slice")
    carried = last.select(*keys, "_slice", F.lag("_last").over(across).alias("_carry"))
    joined = rows.join(carried, [*keys, "_slice"])
    return joined.select(
        *df.columns,
        *[
            F.when(F.col("_first"), F.col("_carry")[v]).otherwise(F.col(f"_in_{v}")).alias(f"prev_{v}")
            for v in values
        ],
    )


def counter_delta(current, previous) -> Column:
    """Increase of a cumulative counter; after a reset the current value is the increase."""
    current, previous = F.col(current), F.col(previous)
    return F.when(current >= previous, current - previous).otherwise(current)
