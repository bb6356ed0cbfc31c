"""Server level: uptime, memory, temp space, configuration, database options."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetgauge.functions.numbers import count_where, idiv, pages_to_mb
from fleetgauge.functions.severity import ATTENTION, CRITICAL, OK, grade
from fleetgauge.functions.timeunits import boundaries, instant
from fleetgauge.operators.topk import top_per
from fleetgauge.plans.lookups import with_database, with_text
from fleetgauge.sources.telemetry import Telemetry, meet, snapshot_keys

# The audited settings, and the value that means "no memory limit".
AUDITED_SETTINGS = (
    "max server memory (MB)", "min server memory (MB)", "max degree of parallelism",
    "cost threshold for parallelism", "optimize for ad hoc workloads", "xp_cmdshell",
    "backup compression default", "remote admin connections",
)
UNLIMITED_MEMORY = 2147483647


def uptime_confidence(t: Telemetry, as_of: datetime) -> DataFrame:
    """How far the counters since restart can be trusted."""
    info = t["server_info"]
    return (
        info.select(*snapshot_keys(info), "start_time", boundaries("day", "start_time", instant(as_of)).alias("days_up"))
        .withColumns(
            grade(
                (F.col("days_up") < 1, ATTENTION, "waits_not_accumulated"),
                (F.col("days_up") < 7, OK, "waits_reliable"),
                otherwise=(OK, "use_deltas"),
            )
        )
    )


def server_uptime(t: Telemetry, as_of: datetime) -> DataFrame:
    now = instant(as_of)
    hours_up = boundaries("hour", "start_time", now)
    info = t["server_info"]
    return (
        info.select(
            *snapshot_keys(info), "cpu_count", idiv(idiv("physical_memory_kb", 1024), 1024).alias("ram_gb"), "start_time",
            boundaries("day", "start_time", now).alias("days_up"), hours_up.alias("hours_up"),
        )
        .withColumns(
            grade(
                (F.col("hours_up") < 24, ATTENTION, "restarted_within_24h"),
                (F.col("days_up") < 7, ATTENTION, "restarted_within_7d"),
            )
        )
        .drop("hours_up")
    )


def availability(t: Telemetry, as_of: datetime) -> DataFrame:
    now = instant(as_of)
    info = t["server_info"]
    return (
        info.select(
            *snapshot_keys(info), F.col("start_time").alias("last_restart"), now.alias("as_of"),
            boundaries("hour", "start_time", now).alias("hours_up"),
            boundaries("day", "start_time", now).alias("days_up"),
        )
        .withColumns(
            grade(
                (F.col("hours_up") < 1, CRITICAL, "restarted_within_1h"),
                (F.col("hours_up") < 24, ATTENTION, "restarted_within_24h"),
                (F.col("days_up") < 7, ATTENTION, "restarted_within_7d"),
            )
        )
        .withColumns(
            grade(
                (F.col("hours_up") < 24, ATTENTION, "counters_incomplete"),
                otherwise=(OK, "counters_sufficient"),
                names=("counter_severity", "counter_reason"),
            )
        )
    )


def memory_grants(t: Telemetry) -> DataFrame:
    """Memory grants with the request and statement that hold or wait for them."""
    grants = t["memory_grant"]
    keys = snapshot_keys(grants)
    requests = t["request_snapshot"].select(*keys, "session_id", "database_id", "sql_handle")
    rows = with_text(grants.join(requests, [*keys, "session_id"]), t, 200, "query")
    return with_database(
        rows.select(
            *keys, "session_id", "database_id", "grant_time",
            idiv("requested_memory_kb", 1024).alias("requested_mb"),
            idiv("granted_memory_kb", 1024).alias("granted_mb"),
            idiv("used_memory_kb", 1024).alias("used_mb"),
            "queue_id", "wait_time_ms", "query", "used_memory_kb", "granted_memory_kb",
        ),
        t,
    ).withColumns(
        grade(
            (F.col("grant_time").isNull(), CRITICAL, "waiting_for_memory"),
            (F.col("used_memory_kb") * 10 < F.col("granted_memory_kb") * 3, ATTENTION, "grant_wasted"),
        )
    ).drop("used_memory_kb", "granted_memory_kb")


def grant_summary(t: Telemetry) -> DataFrame:
    grants = t["memory_grant"]
    return (
        grants.groupBy(*snapshot_keys(grants))
        .agg(
            idiv(F.sum("granted_memory_kb"), 1024).alias("granted_mb"),
            idiv(F.sum("used_memory_kb"), 1024).alias("used_mb"),
            F.count("*").alias("grants"),
            count_where(F.col("grant_time").isNull()).alias("waiting"),
        )
        .withColumns(
            grade(
                (F.col("waiting") > 5, CRITICAL, "long_grant_queue"),
                (F.col("waiting") > 0, ATTENTION, "queries_waiting"),
            )
        )
    )


def grant_queue(t: Telemetry) -> DataFrame:
    grants = t["memory_grant"]
    return grants.select(
        *snapshot_keys(grants), "session_id",
        idiv("requested_memory_kb", 1024).alias("requested_mb"),
        idiv("granted_memory_kb", 1024).alias("granted_mb"),
        "wait_time_ms", "queue_id",
        *[
            c.alias(n)
            for n, c in grade(
                (F.col("grant_time").isNull(), CRITICAL, "waiting_for_memory"), otherwise=(OK, "granted")
            ).items()
        ],
    )


def temp_space(t: Telemetry) -> DataFrame:
    files = t["temp_file_space"]
    return (
        files.groupBy(*snapshot_keys(files))
        .agg(
            *[
                pages_to_mb(F.sum(f"{kind}_pages")).alias(f"{kind}_mb")
                for kind in ("user", "internal", "version", "free")
            ]
        )
        .withColumns(
            grade(
                (F.col("internal_mb") > 1000, CRITICAL, "spills"),
                (F.col("version_mb") > 500, ATTENTION, "version_store"),
                (F.col("user_mb") > 2000, ATTENTION, "temporary_tables"),
            )
        )
    )


def temp_by_session(t: Telemetry, top: int = 20) -> DataFrame:
    """The tasks that use most temp space, with what they run."""
    tasks = t["temp_task_space"].where((F.col("user_pages") > 0) | (F.col("internal_pages") > 0))
    keys = snapshot_keys(tasks)
    sessions = t["session_snapshot"].select(*keys, "session_id", "login_name", "host_name", "program_name")
    pages = F.col("user_pages") + F.col("internal_pages")
    sized = tasks.join(sessions, [*keys, "session_id"]).withColumns(
        {
            "user_mb": pages_to_mb("user_pages"),
            "internal_mb": pages_to_mb("internal_pages"),
            "total_mb": pages_to_mb(pages),
        }
    ).drop("user_pages", "internal_pages")
    # Left joins add no tasks a rank could change on: rank first, look up after.
    ranked = top_per(sized, keys, [F.desc("total_mb"), "session_id", "request_id"], top)
    requests = t["request_snapshot"].select(
        *keys, "session_id", "request_id", "wait_type", "database_id", "sql_handle"
    )
    rows = ranked.join(requests, [*keys, "session_id", "request_id"], "left")
    rows = with_database(with_text(rows, t, 200, "query", how="left"), t)
    return rows.drop("sql_handle", "database_id").withColumns(
        grade(
            (F.col("internal_mb") > 500, CRITICAL, "spill_over_500mb"),
            (F.col("total_mb") > 200, ATTENTION, "high_use"),
        )
    )


def process_memory(t: Telemetry) -> DataFrame:
    memory = t["process_memory"]
    in_use = "physical_memory_in_use_kb"
    return memory.select(
        *snapshot_keys(memory), idiv(in_use, 1024).alias("in_use_mb"),
        idiv(idiv(in_use, 1024), 1024).alias("in_use_gb"), "memory_utilization_pct",
    ).withColumns(
        grade(
            (F.col("memory_utilization_pct") > 95, CRITICAL, "over_95_pct"),
            (F.col("memory_utilization_pct") > 80, ATTENTION, "over_80_pct"),
        )
    )


def page_life(t: Telemetry) -> DataFrame:
    counters = t["perf_counter"]
    return (
        counters.where(
            F.col("counter_name").ilike("Page life expectancy") & F.col("object_name").ilike("%Buffer Manager%")
        )
        .select(*snapshot_keys(counters), F.col("cntr_value").alias("page_life_seconds"))
        .withColumns(
            grade(
                (F.col("page_life_seconds") < 300, CRITICAL, "memory_insufficient"),
                (F.col("page_life_seconds") < 1000, ATTENTION, "watch"),
            )
        )
    )


def memory_cap(t: Telemetry) -> DataFrame:
    """Whether a memory limit is set (one setting per server and snapshot)."""
    memory = t["process_memory"]
    keys = snapshot_keys(memory)
    config = t["server_config"]
    cap = config.where(F.col("name") == "max server memory (MB)").select(
        *snapshot_keys(config), F.col("value_in_use").alias("max_memory_mb")
    )
    return (
        meet(memory, cap, [], "left")
        .select(*keys, "max_memory_mb", idiv("physical_memory_in_use_kb", 1024).alias("in_use_mb"))
        .withColumns(grade((F.col("max_memory_mb") == UNLIMITED_MEMORY, CRITICAL, "no_limit")))
    )


def buffer_by_database(t: Telemetry) -> DataFrame:
    """Cached pages per database, counted map side before any shuffle."""
    pages = t["buffer_page"].where(F.col("database_id") > 4)
    counted = pages.groupBy(*snapshot_keys(pages), "database_id").agg(
        pages_to_mb(F.count("*")).alias("cached_mb")
    )
    return with_database(counted, t).withColumns(
        grade((F.col("cached_mb") > 10000, ATTENTION, "large_cache_share"))
    )


def config_audit(t: Telemetry) -> DataFrame:
    value = F.col("value_in_use")

    def setting(name: str):
        return F.col("name") == name

    config = t["server_config"]
    return (
        config.where(F.col("name").isin(*AUDITED_SETTINGS))
        .select(*snapshot_keys(config), "name", "configured_value", "value_in_use")
        .withColumns(
            grade(
                (setting("max server memory (MB)") & (value == UNLIMITED_MEMORY), CRITICAL, "no_memory_limit"),
                (setting("cost threshold for parallelism") & (value < 25), ATTENTION, "threshold_too_low"),
                (setting("optimize for ad hoc workloads") & (value == 0), ATTENTION, "ad_hoc_off"),
                (setting("xp_cmdshell") & (value == 1), ATTENTION, "shell_enabled"),
                (setting("max degree of parallelism") & (value == 0), ATTENTION, "unlimited_parallelism"),
            )
        )
    )


def database_options(t: Telemetry) -> DataFrame:
    return (
        t["database_dim"]
        .where(F.col("database_id") > 4)
        .select("server_id", "name", "recovery_model", "is_auto_shrink_on", "is_auto_close_on", "page_verify")
        .withColumns(
            grade(
                (F.col("is_auto_shrink_on") == 1, CRITICAL, "auto_shrink"),
                (F.col("is_auto_close_on") == 1, CRITICAL, "auto_close"),
                (F.col("page_verify") != "CHECKSUM", ATTENTION, "page_verify"),
            )
        )
    )


def query_store_capacity(t: Telemetry) -> DataFrame:
    options = t["qs_options"]
    return options.withColumns(
        grade(
            (F.col("actual_state") == "OFF", CRITICAL, "query_store_off"),
            (F.col("actual_state") == "READ_ONLY", ATTENTION, "storage_full"),
            (F.col("current_mb") * 10 > F.col("max_mb") * 8, ATTENTION, "over_80_pct"),
        )
    )
