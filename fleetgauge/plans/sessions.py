"""Requests and sessions: active requests, blocking, session groups, activity."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetgauge.functions.numbers import count_where, idiv
from fleetgauge.functions.severity import ATTENTION, CRITICAL, OK, grade
from fleetgauge.functions.text import statement_slice
from fleetgauge.functions.timeunits import boundaries, instant
from fleetgauge.operators.topk import top_per
from fleetgauge.plans.lookups import having_text, with_database, with_text
from fleetgauge.sources.telemetry import Telemetry, snapshot_keys


def user_sessions(t: Telemetry) -> DataFrame:
    return t["session_snapshot"].where(F.col("is_user_process") == 1)


def user_requests(t: Telemetry) -> DataFrame:
    """Requests of user sessions, with login and host."""
    requests = t["request_snapshot"]
    keys = snapshot_keys(requests)
    sessions = user_sessions(t).select(*keys, "session_id", "login_name", "host_name")
    return requests.join(sessions, [*keys, "session_id"])


def active_requests(t: Telemetry, top: int = 20) -> DataFrame:
    """The requests with most CPU of every snapshot, with their running statement."""
    requests = having_text(user_requests(t).where(F.col("session_id") > 50), t)
    keys = snapshot_keys(requests)
    ranked = top_per(requests, keys, [F.desc("cpu_time"), "session_id", "request_id"], top)
    rows = with_database(with_text(ranked, t), t)
    return rows.select(
        *keys, "rank", "session_id", "request_id", "status", "cpu_time",
        idiv("total_elapsed_time", 1000).alias("elapsed_seconds"),
        "logical_reads", "physical_reads", "writes", "wait_type", "blocking_session_id",
        "database_name", "login_name", "host_name",
        statement_slice("text", "statement_start_offset", "statement_end_offset").alias("statement"),
    ).withColumns(
        grade(
            (F.col("blocking_session_id") > 0, CRITICAL, "blocked"),
            (F.col("cpu_time") > 60000, ATTENTION, "high_cpu"),
            (F.col("elapsed_seconds") > 300, ATTENTION, "long_running"),
        )
    )


def blocking_join(t: Telemetry) -> DataFrame:
    """Blocked requests next to the request that blocks them."""
    requests = t["request_snapshot"]
    keys = snapshot_keys(requests)
    blocked = requests.where(F.col("blocking_session_id") > 0).select(
        *keys,
        F.col("session_id").alias("blocked_session_id"),
        F.col("request_id").alias("blocked_request_id"),
        "blocking_session_id", "wait_type", "wait_time", "database_id",
        F.col("sql_handle").alias("blocked_handle"),
    )
    blocking = requests.select(
        *keys,
        F.col("session_id").alias("blocking_session_id"),
        F.col("request_id").alias("blocking_request_id"),
        F.col("sql_handle").alias("blocker_handle"),
    )
    return blocked.join(blocking, [*keys, "blocking_session_id"])


def blocking_pairs(t: Telemetry, query_length: int | None = 300) -> DataFrame:
    """One row per blocked request and blocker, with both statements."""
    # texts last, so that no other shuffle carries them
    pairs = with_database(blocking_join(t), t)
    keys = snapshot_keys(pairs)
    pairs = with_text(pairs, t, query_length, "blocker_query", "blocker_handle")
    pairs = with_text(pairs, t, query_length, "blocked_query", "blocked_handle")
    return pairs.select(
        *keys, "blocking_session_id", "blocker_query", "blocked_session_id", "blocked_query",
        "wait_type", idiv("wait_time", 1000).alias("wait_seconds"), "database_name",
    ).withColumns(
        grade(
            (F.col("wait_seconds") > 60, CRITICAL, "blocked_over_60s"),
            (F.col("wait_seconds") > 10, ATTENTION, "blocked_over_10s"),
            otherwise=(OK, "recent"),
        )
    )


def collected_sessions(t: Telemetry, collected_at: datetime, own_session: int | None = None) -> DataFrame:
    """Rows for the collector's session log: all user requests but the collector's own."""
    requests = user_requests(t)
    if own_session is not None:
        requests = requests.where(F.col("session_id") != own_session)
    rows = with_text(with_database(requests, t), t)  # texts last, so that no other shuffle carries them
    return rows.select(
        *snapshot_keys(rows), instant(collected_at).alias("collected_at"), "session_id", "status",
        "blocking_session_id", "cpu_time", idiv("total_elapsed_time", 1000).alias("elapsed_seconds"),
        "logical_reads", "writes", "wait_type", idiv("wait_time", 1000).alias("wait_seconds"),
        "database_name", "login_name",
        statement_slice("text", "statement_start_offset", "statement_end_offset").alias("statement"),
    )


def collected_blocks(t: Telemetry, collected_at: datetime) -> DataFrame:
    """Rows for the collector's blocking log, with whole statements."""
    pairs = blocking_pairs(t, query_length=None).drop("severity", "reason", "database_name")
    return pairs.withColumn("collected_at", instant(collected_at))


def session_groups(t: Telemetry, as_of: datetime) -> DataFrame:
    """Sessions counted by login, host, program and status."""
    sessions = user_sessions(t)
    idle = boundaries("minute", "last_request_end_time", instant(as_of))
    return (
        sessions.groupBy(*snapshot_keys(sessions), "login_name", "host_name", "program_name", "status")
        .agg(
            F.count("*").alias("connections"),
            count_where(F.col("status") == "sleeping").alias("sleeping"),
            count_where(F.col("status") == "running").alias("running"),
            F.max(idle).alias("max_idle_minutes"),
        )
        .withColumns(
            grade(
                (F.col("connections") > 100, CRITICAL, "over_100_connections"),
                (F.col("connections") > 50, ATTENTION, "over_50_connections"),
                (F.col("max_idle_minutes") > 60, ATTENTION, "idle_over_1h"),
            )
        )
    )


def idle_sessions(t: Telemetry, as_of: datetime) -> DataFrame:
    """Sleeping user sessions idle for more than 30 minutes."""
    sessions = user_sessions(t)
    return (
        sessions.where(
            (F.col("status") == "sleeping")
            & (F.col("last_request_end_time") < instant(as_of - timedelta(minutes=30)))
        )
        .select(
            *snapshot_keys(sessions), "session_id", "login_name", "host_name", "program_name", "status",
            "last_request_end_time",
            boundaries("minute", "last_request_end_time", instant(as_of)).alias("idle_minutes"),
        )
        .withColumns(
            grade(
                (F.col("idle_minutes") > 120, CRITICAL, "idle_over_2h"),
                (F.col("idle_minutes") > 30, ATTENTION, "idle_over_30min"),
            )
        )
    )


def connections_per_database(t: Telemetry) -> DataFrame:
    requests = t["request_snapshot"].where(F.col("database_id").isNotNull())
    keys = snapshot_keys(requests)
    counted = (
        requests.join(user_sessions(t).select(*keys, "session_id"), [*keys, "session_id"])
        .groupBy(*keys, "database_id")
        .agg(F.count("*").alias("connections"))
    )
    return with_database(counted, t).withColumns(
        grade(
            (F.col("connections") > 200, CRITICAL, "over_200"),
            (F.col("connections") > 100, ATTENTION, "over_100"),
        )
    )


def activity_log_latest(t: Telemetry, top: int = 100) -> DataFrame:
    """The latest rows of each server's collected activity log."""
    return top_per(t["session_activity_log"], ["server_id"], [F.desc("collection_time"), "session_id"], top)


ACTIVITY_FILTERS = {"session": "session_id", "program": "program_name", "database": "database_name",
                    "login": "login_name", "host": "host_name"}
HIDE_SLEEPING, SLEEPING_WITH_TRANSACTION, SHOW_SLEEPING = 0, 1, 2


def activity(
    t: Telemetry,
    include: tuple[str, str] | None = None,
    exclude: tuple[str, str] | None = None,
    show_sleeping: int = SLEEPING_WITH_TRANSACTION,
    sort_by: str = "cpu_time",
    top: int | None = None,
) -> DataFrame:
    """Who is active: sessions with their requests, filtered and ranked per snapshot.

    ``include`` and ``exclude`` are (filter type, value) with the types of
    ACTIVITY_FILTERS. ``sort_by`` is any output measure, ``blocked_sessions`` included.
    """
    sessions = user_sessions(t)
    keys = snapshot_keys(sessions)
    sleeping = F.col("session_status") == "sleeping"
    requests = t["request_snapshot"].withColumnRenamed("status", "request_status")
    rows = sessions.withColumnRenamed("status", "session_status").join(
        requests, [*keys, "session_id"], "left"
    )
    if show_sleeping == HIDE_SLEEPING:
        rows = rows.where(~sleeping)
    elif show_sleeping == SLEEPING_WITH_TRANSACTION:
        rows = rows.where(~sleeping | (F.col("open_transaction_count") > 0))
    rows = with_database(rows, t)
    if include:
        rows = rows.where(F.col(ACTIVITY_FILTERS[include[0]]).eqNullSafe(include[1]))
    if exclude:
        rows = rows.where(~F.col(ACTIVITY_FILTERS[exclude[0]]).eqNullSafe(exclude[1]))
    blocked = (
        t["request_snapshot"].where(F.col("blocking_session_id") > 0)
        .groupBy(*keys, F.col("blocking_session_id").alias("session_id"))
        .agg(F.count("*").alias("blocked_sessions"))
    )
    # Average elapsed time of the statement over this snapshot's sessions.
    average = (
        t["request_snapshot"].groupBy(*keys, "sql_handle")
        .agg(idiv(F.sum("total_elapsed_time"), F.count("*")).alias("avg_elapsed_time"))
    )
    rows = rows.join(blocked, [*keys, "session_id"], "left").join(average, [*keys, "sql_handle"], "left")
    rows = rows.select(
        *keys, "session_id", "request_id", "session_status", "login_name", "host_name", "program_name",
        "database_name", "cpu_time", F.col("logical_reads").alias("reads"),
        F.col("total_elapsed_time").alias("elapsed_time"), "avg_elapsed_time", "wait_type",
        "blocking_session_id", F.coalesce("blocked_sessions", F.lit(0)).alias("blocked_sessions"),
        "open_transaction_count",
    )
    if top is None:
        return rows
    return top_per(rows, keys, [F.desc_nulls_last(sort_by), "session_id", "request_id"], top)


def activity_log_rows(t: Telemetry, collected_at: datetime) -> DataFrame:
    """Rows for the activity log that activity_log_latest reads."""
    rows = activity(t)
    keys = snapshot_keys(rows)
    handles = t["request_snapshot"].select(*keys, "session_id", "request_id", "sql_handle")
    rows = with_text(rows.join(handles, [*keys, "session_id", "request_id"], "left"), t, how="left")
    return rows.select(
        "server_id", instant(collected_at).alias("collection_time"), "session_id",
        F.col("session_status").alias("status"), F.col("cpu_time").alias("cpu"), "reads", "elapsed_time",
        F.col("wait_type").alias("wait_info"), "blocking_session_id", "database_name",
        F.col("text").alias("sql_text"),
    )
