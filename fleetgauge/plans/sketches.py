"""Column statistics that merge: sketches for each date partition, refreshed where files have changed.

A partition of a table has, for each column, its rows, nulls and ends, a HyperLogLog sketch
(distinct values, relative standard error 1.04 / sqrt(2 ^ `LG_REGISTERS`) = 1.6 %) and, if the column
is a number, a KLL sketch (quantiles, rank error 1.33 % at `ACCURACY`, with 99 % confidence). Statistics of the table, or
of any range of dates, are merged from these without reading the table again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetgauge.sources.compaction import Folder

LG_REGISTERS, ACCURACY = 12, 200
#: Bounds that tests hold: three standard errors, and the stated rank error.
DISTINCT_ERROR, RANK_ERROR = 0.05, 0.0133


def _countable(df: DataFrame, column: str) -> Column:
    return F.col(column) if isinstance(df.schema[column].dataType, (T.IntegralType, T.StringType)) else F.col(column).cast("string")


def partition_sketches(df: DataFrame, columns, partition: str) -> DataFrame:
    """partition, column_name, rows, null_rows, low, high, distinct_sketch, quantile_sketch: one pass over the rows, combined map side."""
    numbers = {c for c in columns if isinstance(df.schema[c].dataType, T.NumericType)}
    sums = [F.count("*").alias("rows")]
    for k, c in enumerate(columns):
        own = F.col(c).cast("double")
        sums += [F.count(c).alias(f"n{k}"), F.hll_sketch_agg(_countable(df, c), LG_REGISTERS).alias(f"d{k}")]
        if c in numbers:
            sums += [F.min(own).alias(f"l{k}"), F.max(own).alias(f"h{k}"), F.kll_sketch_agg_double(own, ACCURACY).alias(f"q{k}")]

    def part(k: int, c: str) -> Column:
        number = lambda name, kind: (F.col(f"{name}{k}") if c in numbers else F.lit(None).cast(kind))
        return F.struct(
            F.lit(c).alias("column_name"), F.col("rows").alias("rows"), (F.col("rows") - F.col(f"n{k}")).alias("null_rows"),
            number("l", "double").alias("low"), number("h", "double").alias("high"), F.col(f"d{k}").alias("distinct_sketch"), number("q", "binary").alias("quantile_sketch"),
        )

    grouped = df.groupBy(partition).agg(*sums)
    return grouped.select(partition, F.explode(F.array(*[part(k, c) for k, c in enumerate(columns)])).alias("s")).select(partition, "s.*")


def merged(sketches: DataFrame, keys=()) -> DataFrame:
    """Sketches of several partitions as one for each column (and key)."""
    return sketches.groupBy(*keys, "column_name").agg(
        F.sum("rows").alias("rows"), F.sum("null_rows").alias("null_rows"), F.min("low").alias("low"), F.max("high").alias("high"),
        F.hll_union_agg("distinct_sketch").alias("distinct_sketch"), F.kll_merge_agg_double("quantile_sketch").alias("quantile_sketch"),
    )


def statistics(sketches: DataFrame, quantiles=(0.25, 0.5, 0.75)) -> DataFrame:
    """column_name, rows, null_rows, low, high, distinct_values, density and a column for each quantile, from merged sketches."""
    distinct = F.hll_sketch_estimate("distinct_sketch")
    held = F.col("low").isNotNull()  # a column without numbers has none
    at = [F.when(held, F.kll_sketch_get_quantile_double("quantile_sketch", F.lit(q))).alias(f"q{round(100 * q):02d}") for q in quantiles]
    return sketches.select(
        "column_name", "rows", "null_rows", "low", "high", distinct.alias("distinct_values"),
        (F.lit(1.0) / F.nullif(distinct, F.lit(0))).alias("density"), *at,
    )


def fingerprints(source: DataFrame, partition: str) -> DataFrame:
    """partition, fingerprint: its files, with their sizes and times, as one hash. No column of the files is read."""
    files = source.select(partition, F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_size").alias("s"), F.col("_metadata.file_modification_time").alias("t"))
    each = files.distinct().select(partition, F.xxhash64("f", "s", "t").alias("h"))
    return each.groupBy(partition).agg(F.sum(F.col("h").cast("decimal(38,0)")).cast("string").alias("fingerprint"))


def refresh(spark: SparkSession, source_path: str, store_path: str, columns, partition: str = "dt") -> list:
    """Bring the stored sketches of a partitioned table up to date; the partitions that were read (one value each)."""
    source = spark.read.parquet(source_path)
    now = fingerprints(source, partition)
    if Folder(spark, store_path).names():
        known = spark.read.parquet(store_path).select(partition, "fingerprint").distinct()
        now = now.join(known, [partition, "fingerprint"], "left_anti")
    marks = {r[partition]: r["fingerprint"] for r in now.collect()}  # a row for each changed partition
    if marks:
        changed = source.where(F.col(partition).isin(list(marks)))
        made = partition_sketches(changed, columns, partition)
        named = F.create_map(*[F.lit(x) for pair in marks.items() for x in pair])
        made = made.withColumn("fingerprint", named[F.col(partition)])
        made.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(store_path)
    return sorted(marks)


def stored(spark: SparkSession, source_path: str, store_path: str, partition: str = "dt") -> DataFrame:
    """The stored sketches of the partitions that the table still has."""
    here = spark.read.parquet(source_path).select(partition).distinct()
    return spark.read.parquet(store_path).join(here, partition, "left_semi")
