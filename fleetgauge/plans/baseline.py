"""Before/after comparison: capture a phase, compare two phases.

Captures keep the snapshots of what they read; each reading of a later phase is compared
with the latest capture of the first that is not after it.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetgauge.functions.numbers import percent, ratio, zero_if_null
from fleetgauge.functions.severity import ATTENTION, CRITICAL, OK, grade
from fleetgauge.functions.timeunits import instant
from fleetgauge.functions.waits import BASELINE_WAITS, IO_LATCH, LOCK_PATTERN
from fleetgauge.operators.asof import as_of_join, time_of
from fleetgauge.plans.indexes import started_since
from fleetgauge.sources.telemetry import Telemetry, meet, snapshot_keys

BEFORE, AFTER_1D, AFTER_7D = "before", "24h", "7d"


def _stamp(phase: str, captured_at: datetime) -> list[Column]:
    return [F.lit(phase).alias("phase"), instant(captured_at).alias("captured_at")]


def capture_index_usage(
    t: Telemetry, phase: str, captured_at: datetime, tables=None, usage: str = "index_usage"
) -> DataFrame:
    indexes = t["index_dim"].where((F.col("type_desc") != "HEAP") & (F.col("is_disabled") == 0))
    if tables is not None:
        indexes = indexes.where(F.col("table_name").isin(*tables))
    # every index meets every snapshot of its server first, so that one without a row there shows
    rows = indexes.join(snapshots(t[usage]), "server_id", "left") if "snapshot_ts" in t[usage].columns else indexes
    rows = meet(meet(rows, t[usage], ["index_id"], "left"), started_since(t), [], "left")
    return rows.select(
        *_stamp(phase, captured_at), *snapshot_keys(rows), "database_id", "table_name", "index_name",
        *[zero_if_null(f"user_{k}").alias(k) for k in ("seeks", "scans", "lookups", "updates")],
        "counters_since",
    )


def capture_fragmentation(
    t: Telemetry, phase: str, captured_at: datetime, tables=None,
    physical: str = "index_physical", operational: str = "index_operational",
) -> DataFrame:
    """Page splits are summed per index first: an index has one row per partition there."""
    indexes = t["index_dim"].where(F.col("index_name").isNotNull())
    if tables is not None:
        indexes = indexes.where(F.col("table_name").isin(*tables))
    splits = t[operational].groupBy(*snapshot_keys(t[operational]), "index_id").agg(
        F.sum("leaf_allocation_count").alias("page_splits")
    )
    named = t[physical].where(F.col("page_count") > 1000).join(
        indexes.select("server_id", "database_id", "index_id", "table_name", "index_name"),
        ["server_id", "database_id", "index_id"],
    )
    rows = meet(named, splits, ["index_id"], "left")
    return rows.select(
        *_stamp(phase, captured_at), *snapshot_keys(rows), "database_id", "table_name", "index_name",
        ratio("fragmentation_tenths", F.lit(10), 5, 1).alias("fragmentation_pct"), "page_count",
        "record_count", zero_if_null("page_splits").alias("page_splits"),
    )


def capture_waits(t: Telemetry, phase: str, captured_at: datetime, waits: str = "wait_snapshot") -> DataFrame:
    return (
        t[waits]
        .where(F.upper("wait_type").isin(*BASELINE_WAITS) & (F.col("wait_time_ms") > 0))
        .select(
            *_stamp(phase, captured_at), *snapshot_keys(t[waits]), "wait_type", "wait_time_ms",
            F.col("waiting_tasks_count").alias("waiting_tasks"),
        )
    )


def snapshots(counters: DataFrame) -> DataFrame:
    """The snapshots of every server."""
    return counters.select("server_id", "snapshot_ts").distinct()


def _phases(baseline: DataFrame, phase: str, keys, measures) -> DataFrame:
    """Readings of a phase (d_*) with the latest earlier capture (a_*) of the same entity, from one stored table.

    The time of a reading is its snapshot's, else that of the capture. A table without
    snapshots gives one result for each entity, of the phase's last capture.
    """
    before = baseline.where(F.col("phase") == BEFORE)
    after = baseline.where(F.col("phase") == phase)
    if "snapshot_ts" not in baseline.columns and "captured_at" in baseline.columns:
        latest = after.groupBy("server_id").agg(F.max("captured_at").alias("captured_at"))
        after = after.join(latest, ["server_id", "captured_at"], "left_semi")
    times = [c for c in ("snapshot_ts", "captured_at") if c in baseline.columns]
    was = before.select(*keys, *times, *[F.col(m).alias(f"a_{m}") for m in measures])
    now = after.select(*keys, *times, *[F.col(m).alias(f"d_{m}") for m in measures])
    return as_of_join(now, was, keys, time_of(now, *times), time_of(was, *times), [f"a_{m}" for m in measures], prefix="")


def _entity(rows: DataFrame, keys) -> list[str]:
    """The columns that name a result: its keys, and the snapshot where there is one."""
    return [*snapshot_keys(rows), *[k for k in keys if k != "server_id"]]


def _change(measure: str) -> Column:
    return F.col(f"d_{measure}") - F.col(f"a_{measure}")


INDEX_KEY = ("server_id", "database_id", "table_name", "index_name")


def index_usage_delta(baseline: DataFrame, phase: str = AFTER_7D) -> DataFrame:
    measures = ("seeks", "scans", "lookups", "updates")
    rows = _phases(baseline, phase, INDEX_KEY, measures)
    seeks, scans, lookups, updates = (F.col(f"delta_{m}") for m in measures)
    return rows.select(
        *_entity(rows, INDEX_KEY), *[_change(m).alias(f"delta_{m}") for m in measures]
    ).withColumn("seeks_per_update", ratio("delta_seeks", "delta_updates", 12, 2)).withColumns(
        grade(
            ((seeks > 1000) & (lookups < 1000), OK, "works_well"),
            (seeks > 100, OK, "used"),
            (lookups > 10_000, ATTENTION, "many_lookups"),
            ((scans > seeks) & (scans > 1000), ATTENTION, "scans_dominate"),
            ((seeks == 0) & (updates > 0), CRITICAL, "write_cost_only"),
            ((seeks == 0) & (updates == 0), ATTENTION, "no_activity"),
            otherwise=(ATTENTION, "little_used"),
        )
    )


def fragmentation_delta(baseline: DataFrame, phase: str = AFTER_7D) -> DataFrame:
    rows = _phases(baseline, phase, INDEX_KEY, ("fragmentation_pct", "page_splits", "page_count"))
    after = F.col("after_pct")
    return rows.select(
        *_entity(rows, INDEX_KEY), F.col("a_fragmentation_pct").alias("before_pct"),
        F.col("d_fragmentation_pct").alias("after_pct"), _change("fragmentation_pct").alias("delta_pct"),
        _change("page_splits").alias("delta_page_splits"), F.col("d_page_count").alias("page_count"),
    ).withColumns(
        grade(
            (F.col("delta_page_splits") > 10_000, CRITICAL, "many_page_splits"),
            ((after > 30) & (F.col("page_count") > 1000), CRITICAL, "rebuild_needed"),
            (after.between(10, 30), ATTENTION, "reorganize"),
        )
    )


def wait_change(baseline: DataFrame, phase: str = AFTER_7D) -> DataFrame:
    rows = _phases(baseline, phase, ("server_id", "wait_type"), ("wait_time_ms",))
    wait, delta = F.upper("wait_type"), F.col("delta_ms")
    io = wait.isin(*IO_LATCH)
    return rows.select(
        *_entity(rows, ("wait_type",)), F.col("a_wait_time_ms").alias("before_ms"),
        F.col("d_wait_time_ms").alias("after_ms"), _change("wait_time_ms").alias("delta_ms"),
    ).withColumn("change_pct", percent("delta_ms", "before_ms", 18, 1)).withColumns(
        grade(
            (io & (delta < 0), OK, "io_improved"),
            ((wait == "CXPACKET") & (delta < 0), OK, "parallelism_reduced"),
            (io & (delta > 0), ATTENTION, "io_worse"),
            ((wait == "WRITELOG") & (delta > 0), ATTENTION, "log_grew"),
            (F.col("wait_type").ilike(LOCK_PATTERN) & (delta > 0), ATTENTION, "lock_contention_grew"),
            otherwise=(OK, "no_significant_change"),
        )
    )
