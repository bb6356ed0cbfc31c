"""Running row counts in value order without sorting everything in one task."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetgauge.session import work_path


def value_counts(df: DataFrame, keys, column: str) -> DataFrame:
    """Rows per distinct value, combined map side; the null value counts negatively.

    One aggregate serves the frequencies and the null count, so a report that needs
    both reads the table once.
    """
    each = F.when(F.col(column).isNull(), -1).otherwise(1)
    return df.groupBy(*keys, F.col(column).alias("value")).agg(F.sum(each).alias("rows"))


def frequencies(df: DataFrame, keys, column: str) -> DataFrame:
    """Rows per distinct non-null value."""
    return value_counts(df, keys, column).where(F.col("rows") > 0)


CHUNK = 16


def cut_points(values: DataFrame) -> Column:
    """The distinct ``value``s of a small frame as a scalar: sorted, in chunks of sixteen.

    The frame must be bounded by its maker (a limit, the steps of a histogram).
    """
    whole = values.agg(F.array_sort(F.collect_set("value")).alias("cuts"))
    last = F.greatest(F.call_function("div", F.size("cuts") - 1, F.lit(CHUNK)), F.lit(0)).cast("int")
    chunks = whole.select(
        F.transform(F.sequence(F.lit(0), last), lambda i: F.slice("cuts", i * CHUNK + 1, CHUNK)).alias("chunks")
    )
    heads = F.transform("chunks", lambda chunk: F.get(chunk, F.lit(0)))
    return chunks.select(F.struct(heads.alias("heads"), "chunks")).scalar()


def cuts_below(cuts: Column, value: Column) -> Column:
    """How many cut points lie below a value.

    Two lookups in short arrays: among the heads of the chunks, then inside one chunk.
    A value's place in a sorted array is found by sorting it in, for Spark admits no
    subquery in a lambda. coalesce marks the result as never null; otherwise Spark
    infers a not-null filter from it and evaluates it for raw rows below an aggregate.
    """

    def smaller(array: Column) -> Column:
        return F.array_position(F.sort_array(F.array_append(array, value)), value) - 1

    chunk = smaller(cuts["heads"])
    inside = smaller(F.get(cuts["chunks"], (chunk - 1).cast("int")))
    return F.coalesce(F.when(chunk > 0, (chunk - 1) * CHUNK + inside), F.lit(0))


def ranges(freq: DataFrame, order, slices: int | None = None) -> DataFrame:
    """The rows in slices of consecutive ``order``, with ``_slice`` and ``_run``, the sum of ``rows`` before a row in its slice.

    Spark samples the rows for the borders of the slices, so that these follow the data, in
    size and in number: as many as ``slices``, or as shuffle partitions, of which adaptive
    execution joins small ones. The result is stored, since borders may differ from one
    evaluation to the next.
    """
    dealt = freq.repartitionByRange(slices, *order) if slices else freq.repartitionByRange(*order)
    placed = dealt.sortWithinPartitions(*order).withColumn("_slice", F.spark_partition_id())
    schema = T.StructType([*placed.schema, T.StructField("_run", T.LongType())])
    at = placed.columns.index("rows")

    def run(batches):
        total = 0
        for batch in batches:
            rows = batch.column(at).to_numpy(zero_copy_only=False)
            sums = total + np.cumsum(rows)
            total = int(sums[-1]) if len(sums) else total
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sums - rows)], names=schema.names)

    path = work_path(freq.sparkSession, "ranges")
    placed.mapInArrow(run, schema).write.parquet(path)
    return freq.sparkSession.read.schema(schema).parquet(path)


def with_rows_below(freq: DataFrame, keys=(), slices: int | None = None) -> DataFrame:
    """Add ``below`` (rows of smaller values of the same key) and ``total`` (all its rows).

    A prefix sum over slices of the range of (key, value): a pass puts the rows into
    slices and counts inside each, the sums of the slices of a key (a row for each
    pair of key and slice that meet) give its offsets, a second pass adds them. A key with very many values
    is spread over as many slices as its rows fill, many small keys share one.
    """
    keys = list(keys)
    placed = ranges(freq, [*keys, "value"], slices)
    sums = placed.groupBy(*keys, "_slice").agg(F.sum("rows").alias("_rows"), F.min("_run").alias("_first"))
    by_key = Window.partitionBy(*(keys or [F.lit(0)]))  # without keys: a row for each slice
    before = by_key.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(
        *keys, "_slice", "_first", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset"), F.sum("_rows").over(by_key).alias("total")
    )
    return (
        placed.join(offsets, [*keys, "_slice"])
        .withColumn("below", F.col("_offset") + F.col("_run") - F.col("_first"))
        .drop("_slice", "_offset", "_run", "_first")
    )
