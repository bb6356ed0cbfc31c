"""Sinks: partitioned appends for collectors and baselines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_batch(rows: DataFrame, path: str, time: str, batch_id: int) -> None:
    """Write one batch into its own date/batch partitions, replacing an earlier attempt."""
    (
        rows.withColumns({"dt": F.to_date(time), "batch_id": F.lit(batch_id)})
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic").option("compression", "zstd")
        .partitionBy("dt", "batch_id")
        .parquet(path)
    )


def append_by_date(rows: DataFrame, path: str, time: str) -> None:
    """Append to a table partitioned by date, so that readers prune by time range."""
    rows.withColumn("dt", F.to_date(time)).write.mode("append").partitionBy("dt").parquet(path)


def save_phase(rows: DataFrame, path: str) -> None:
    """Store a baseline capture with its snapshot (null where the capture has none).

    Captures of several days stay side by side; capturing a phase again replaces that day's.
    """
    if "snapshot_ts" not in rows.columns:
        rows = rows.withColumn("snapshot_ts", F.lit(None).cast("timestamp"))
    (
        rows.withColumn("captured_on", F.to_date(F.coalesce("snapshot_ts", "captured_at")))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("phase", "captured_on")
        .parquet(path)
    )


def save_capture(rows: DataFrame, path: str, capture_id: str) -> DataFrame:
    """Store a capture under an id and return it as read back."""
    target = f"{path}/capture_id={capture_id}"
    rows.write.mode("overwrite").parquet(target)
    return rows.sparkSession.read.schema(rows.schema).parquet(target)


def schema_of(report: DataFrame) -> str:
    """The DDL column list a table for this report needs."""
    return report.schema.toDDL()


def save_bucketed(rows: DataFrame, table: str, keys, buckets: int, path: str | None = None) -> None:
    """Store a table bucketed and sorted by its join keys: tables bucketed alike join and
    aggregate on these keys without a shuffle (the Query Store tables by server and plan,
    requests and sessions by server, snapshot and session)."""
    writer = rows.write.mode("overwrite").option("compression", "zstd").bucketBy(buckets, *keys).sortBy(*keys)
    (writer.option("path", path) if path else writer).saveAsTable(table)
