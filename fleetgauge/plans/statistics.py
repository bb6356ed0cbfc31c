"""Optimizer statistics: stale, thin or filtered ones, and what to refresh."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetgauge.functions.numbers import percent
from fleetgauge.functions.severity import ATTENTION, CRITICAL, grade
from fleetgauge.functions.text import quote_name
from fleetgauge.functions.timeunits import instant
from fleetgauge.plans.indexes import scan_mode
from fleetgauge.sources.telemetry import Telemetry, snapshot_keys

KEY = ("database_id", "table_name", "stats_name")


def _update_command(full_scan: bool):
    parts = [F.lit("UPDATE STATISTICS "), quote_name("table_name"), F.lit(" "), quote_name("stats_name")]
    return F.concat(*parts, F.lit(" WITH FULLSCAN")) if full_scan else F.concat(*parts)


def stale_statistics(t: Telemetry, as_of: datetime) -> DataFrame:
    changed, rows = F.col("modification_counter"), F.col("total_rows")
    old = F.col("last_updated") < instant(as_of - timedelta(days=7))
    stats = t["stats_properties"]
    return (
        stats.where(F.col("table_name").isNotNull() & (rows > 0) & ((changed > 1000) | old))
        .select(
            *snapshot_keys(stats), *KEY, "last_updated", "total_rows", "modification_counter",
            percent("modification_counter", "total_rows", 12, 1).alias("changed_pct"),
            _update_command(True).alias("update_command"), scan_mode().alias("scan_mode"),
            *[
                c.alias(n)
                for n, c in grade(
                    (changed * 10 > rows * 2, CRITICAL, "changed_over_20_pct"),
                    (changed * 10 > rows, ATTENTION, "changed_over_10_pct"),
                    (changed > 10_000, ATTENTION, "many_changes"),
                    (old, ATTENTION, "older_than_7d"),
                ).items()
            ],
        )
    )


def statistics_diagnosis(t: Telemetry, as_of: datetime) -> DataFrame:
    """Statistics that may mislead the optimizer; sort_bucket orders the worst first."""
    changed, rows, sampled = F.col("modification_counter"), F.col("total_rows"), F.col("rows_sampled")
    old = F.col("last_updated") < instant(as_of - timedelta(days=14))
    thin, coarse = sampled * 10 < rows, F.col("steps") < 10
    stats = t["stats_properties"]
    return (
        stats.where(F.col("table_name").isNotNull() & (rows > 1000) & ((changed * 10 > rows) | thin | coarse | old))
        .select(
            *snapshot_keys(stats), *KEY, "has_filter", "filter_definition", "last_updated", "total_rows", "rows_sampled",
            percent("rows_sampled", "total_rows", 12, 1).alias("sampled_pct"), "steps", "modification_counter",
            percent("modification_counter", "total_rows", 12, 1).alias("changed_pct"),
            _update_command(False).alias("update_command"), _update_command(True).alias("full_scan_command"),
            F.when(changed * 10 > rows * 2, 1).when(changed * 10 > rows, 2).when(thin, 3).otherwise(4).alias(
                "sort_bucket"
            ),
            *[
                c.alias(n)
                for n, c in grade(
                    (changed * 10 > rows * 3, CRITICAL, "changed_over_30_pct"),
                    (changed * 10 > rows * 2, CRITICAL, "changed_over_20_pct"),
                    (changed * 10 > rows, ATTENTION, "changed_over_10_pct"),
                    (thin & (rows > 100_000), ATTENTION, "thin_sample"),
                    (coarse & (rows > 50_000), ATTENTION, "few_steps"),
                    (old, ATTENTION, "older_than_14d"),
                ).items()
            ],
        )
    )


def filtered_statistics(t: Telemetry, as_of: datetime) -> DataFrame:
    old = F.col("last_updated") < instant(as_of - timedelta(days=7))
    stats = t["stats_properties"]
    return (
        stats.where((F.col("has_filter") == 1) & F.col("table_name").isNotNull())
        .select(*snapshot_keys(stats), *KEY, "filter_definition", "last_updated", "total_rows", "steps")
        .withColumns(grade((old, ATTENTION, "filtered_statistics_old")))
    )


def refresh_scope(t: Telemetry) -> DataFrame:
    """The statistics a blanket refresh would touch: those with modified rows."""
    stats = t["stats_properties"]
    return stats.where(F.col("modification_counter") > 0).select(
        *snapshot_keys(stats), *KEY, "modification_counter", "total_rows"
    )


def scan_mode_gate(t: Telemetry) -> DataFrame:
    """Whether refreshing a table's statistics may read it whole, from its partition row counts."""
    counts = rows_per_table(t)
    return counts.select(*snapshot_keys(counts), "table_name", "row_count", scan_mode("row_count").alias("scan_mode"))


def rows_per_table(t: Telemetry, table: str | None = None) -> DataFrame:
    partitions = t["partition_rows"]
    if table is not None:
        partitions = partitions.where(F.col("table_name") == table)
    return partitions.groupBy(*snapshot_keys(partitions), "table_name").agg(F.sum("row_count").alias("row_count"))
