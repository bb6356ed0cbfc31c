"""Wait statistics: shares, deltas between captures, dominant waits."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetgauge.functions.numbers import percent
from fleetgauge.functions.severity import ATTENTION, CRITICAL, grade
from fleetgauge.functions.timeunits import instant
from fleetgauge.functions.waits import (
    IDLE_COLLECTOR, IDLE_FULL, IDLE_PATTERNS, IDLE_PLAYBOOK, active_waits, cause, next_report,
)
from fleetgauge.operators.asof import as_of_join, time_of
from fleetgauge.operators.previous import counter_delta, with_previous
from fleetgauge.operators.topk import top_per
from fleetgauge.operators.totals import with_totals
from fleetgauge.sources.telemetry import Telemetry, snapshot_keys


def _top_shares(waits: DataFrame, top: int) -> DataFrame:
    """The longest waits of every server with their share of all counted waits.

    Only the ranked rows meet the totals, and both sides come out of map-side
    combined shuffles, so a server with very many rows is no bottleneck.
    """
    keys = snapshot_keys(waits)
    ranked = top_per(waits, keys, [F.desc("wait_time_ms"), "wait_type"], top)
    return with_totals(ranked, waits, keys, {"total_ms": F.sum("wait_time_ms")}).withColumns(
        {
            "share_pct": percent("wait_time_ms", "total_ms"),
            "signal_pct": percent("signal_wait_time_ms", "wait_time_ms", 7),
        }
    ).drop("total_ms")


def _share_ladder() -> dict:
    return grade(
        (F.col("share_pct") > 30, CRITICAL, "dominates"),
        (F.col("share_pct") > 10, ATTENTION, "relevant"),
    )


def wait_ranking(t: Telemetry, top: int = 20, exclude=IDLE_FULL) -> DataFrame:
    waits = t["wait_snapshot"].where(active_waits(exclude))
    return _top_shares(waits, top).withColumn("cause", cause()).withColumns(_share_ladder())


def wait_actions(t: Telemetry, top: int = 10) -> DataFrame:
    """The short form for incidents: ten waits and what to do about them."""
    waits = t["wait_snapshot"].where(active_waits(IDLE_PLAYBOOK)).drop("max_wait_time_ms")
    return (
        _top_shares(waits, top).withColumn("action", cause(extended=False)).withColumns(_share_ladder())
    )


def dominant_wait(t: Telemetry) -> DataFrame:
    """The longest wait of every server and the report to read next."""
    waits = t["wait_snapshot"].where(active_waits(IDLE_PLAYBOOK))
    return (
        _top_shares(waits, 1)
        .select(*snapshot_keys(waits), "wait_type", "wait_time_ms", "share_pct")
        .withColumn("next_report", next_report())
    )


def capture_waits(t: Telemetry, table: str = "wait_snapshot") -> DataFrame:
    """A capture to compare against later: waits that are no idle pattern."""
    waits = t[table].where(active_waits((), IDLE_PATTERNS))
    return waits.select(
        *snapshot_keys(waits), "wait_type", "waiting_tasks_count", "wait_time_ms", "signal_wait_time_ms"
    )


def wait_delta(before: DataFrame, after: DataFrame, include_new: bool = False) -> DataFrame:
    """Increase per wait type between each reading and the latest capture that is not after it.

    Readings keep their snapshot. A table without ``snapshot_ts`` is one reading of each
    server: a capture older than all readings, a reading later than all captures. Keeps
    increases only. New wait types are dropped unless ``include_new``.
    """
    was = before.select(
        *snapshot_keys(before), "wait_type",
        F.col("wait_time_ms").alias("before_ms"),
        F.col("waiting_tasks_count").alias("before_tasks"),
    )
    keys = snapshot_keys(after)
    now = after.select(*keys, "wait_type", "wait_time_ms", "waiting_tasks_count")
    joined = as_of_join(
        now, was, ["server_id", "wait_type"], time_of(now, "snapshot_ts"), time_of(was, "snapshot_ts"),
        ["before_ms", "before_tasks"], prefix="", how="left" if include_new else "inner",
    )
    before_ms = F.coalesce("before_ms", F.lit(0))
    before_tasks = F.coalesce("before_tasks", F.lit(0))
    return (
        joined.where(F.col("wait_time_ms") > before_ms)
        .select(
            *keys, "wait_type",
            (F.col("wait_time_ms") - before_ms).alias("delta_wait_ms"),
            (F.col("waiting_tasks_count") - before_tasks).alias("delta_tasks"),
        )
        .withColumns(
            grade(
                (F.col("delta_wait_ms") > 60000, CRITICAL, "over_1min"),
                (F.col("delta_wait_ms") > 10000, ATTENTION, "relevant"),
            )
        )
    )


def collected_waits(t: Telemetry, collected_at: datetime, top: int = 15) -> DataFrame:
    """Rows for the collector's wait log."""
    waits = t["wait_snapshot"].where(active_waits(IDLE_COLLECTOR))
    return _top_shares(waits, top).select(
        *snapshot_keys(waits), instant(collected_at).alias("collected_at"), "rank", "wait_type",
        "waiting_tasks_count", "wait_time_ms", "signal_wait_time_ms", "share_pct",
    )


def sampled_deltas(t: Telemetry, since_startup: bool = False) -> DataFrame:
    """Change between consecutive readings of every counter, or since startup.

    A counter that fell was reset by a restart: its current value is the change.
    """
    series = t["wait_series"]
    if since_startup:
        latest = series.groupBy("server_id", "wait_type").agg(
            F.max("snapshot_ts").alias("snapshot_ts"),
            F.max_by("wait_time_ms", "snapshot_ts").alias("delta_ms"),
        )
        return latest.withColumn("was_reset", F.lit(0))
    rows = with_previous(
        series, ["server_id", "wait_type"], ["snapshot_ts"],
        F.date_trunc("month", "snapshot_ts"), ["snapshot_ts", "wait_time_ms"],
    ).where(F.col("prev_snapshot_ts").isNotNull())
    seconds = F.unix_seconds("snapshot_ts") - F.unix_seconds("prev_snapshot_ts")
    return rows.select(
        "server_id", "wait_type", "prev_snapshot_ts", "snapshot_ts",
        counter_delta("wait_time_ms", "prev_wait_time_ms").alias("delta_ms"),
        seconds.alias("seconds"),
        (F.col("wait_time_ms") < F.col("prev_wait_time_ms")).cast("int").alias("was_reset"),
    ).withColumn("ms_per_second", F.col("delta_ms") / F.col("seconds"))
