"""Reader for error logs as text files: entries of one line or many."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Fixed value: how an entry begins: time, then the part of the server that wrote it.
ENTRY = r"^(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}(?:\.\d+)?)\s+(\S+)\s+(.*)$"


def located_lines(spark: SparkSession, root: str) -> DataFrame:
    """Every line with its file, the split of the file that it was read in, and its number there."""
    lines = spark.read.option("basePath", root).text(f"{root}/server_id=*/log_id=*").select(
        F.col("server_id").cast("bigint").alias("server_id"), F.col("log_id").cast("bigint").alias("log_id"), F.col("value").alias("line"),
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("_read"),
    )
    in_split = Window.partitionBy("file", "split").orderBy("_read")  # a task reads a split from its first line to its last
    return lines.withColumn("number", F.row_number().over(in_split)).drop("_read")


def read_error_log(spark: SparkSession, root: str) -> DataFrame:
    """The error_log table from ``<root>/server_id=<id>/log_id=<n>/*``, by Spark's text source.

    A line that does not begin with a time goes on from the entry before it, also where a
    file is read in several splits: the last entry that begins in a split is carried into
    the splits after it. An entry's lines are its text. Lines before a file's first entry are entries of
    their own, without time and type. An entry's lines are gathered in one row, so that it
    should fit in memory; files may be of any size.
    """
    lines = located_lines(spark, root)
    here = F.struct("split", "number")
    lines = lines.withColumn("_begin", F.when(F.regexp_extract("line", ENTRY, 1) != "", here))
    so_far = Window.partitionBy("file", "split").orderBy("number").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)  # a row for each split
    carried = lines.groupBy("file", "split").agg(F.max("_begin").alias("_last")).select(
        F.col("file").alias("_file"), F.col("split").alias("_split"), F.last("_last", ignorenulls=True).over(before).alias("_carry")
    )
    owned = lines.withColumn("_own", F.last("_begin", ignorenulls=True).over(so_far))
    joined = owned.join(carried, (F.col("file") == F.col("_file")) & (F.col("split") == F.col("_split")))
    whole = joined.groupBy("server_id", "log_id", "file", F.coalesce("_own", "_carry", here).alias("entry")).agg(
        F.array_sort(F.collect_list(F.struct("split", "number", "line"))).alias("lines")
    )
    first = F.col("lines")[0]["line"]
    part = lambda k: F.regexp_extract(first, ENTRY, k)
    found = part(1) != ""
    rest = F.transform(F.slice("lines", 2, F.greatest(F.size("lines") - 1, F.lit(1))), lambda x: x["line"])
    text = F.array_join(F.concat(F.array(F.when(found, part(3)).otherwise(first)), rest), "\n")
    return whole.select(
        "server_id", "log_id", F.when(found, part(2)).alias("log_type"), F.when(found, F.try_to_timestamp(part(1))).alias("event_ts"), text.alias("text"),
    )
