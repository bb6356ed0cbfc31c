"""The findings feed: graded reports normalised to one row shape and stacked."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetgauge.plans.lookups import with_database
from fleetgauge.sources.telemetry import Telemetry

# Report -> the columns that name what a row is about, beside its server, snapshot and database.
ENTITIES = {
    "q01_uptime_confidence": ("server_id",),
    "q03_active_requests": ("session_id", "request_id"),
    "q04a_query_cpu": ("query_hash",),
    "q04b_proc_cpu": ("proc_name",),
    "q04d_wait_delta": ("wait_type",),
    "q05_wait_ranking": ("wait_type",),
    "q06_blocking_pairs": ("blocking_session_id", "blocked_session_id"),
    "q07a_session_groups": ("login_name", "host_name", "program_name", "status"),
    "q07b_idle_sessions": ("session_id",),
    "q07c_connections_per_db": ("database_id",),
    "q08_missing_indexes": ("table_name", "rank"),
    "q09a_fragmentation": ("table_name", "index_name"),
    "q09b_maintenance_log": ("command_id",),
    "q10_unused_indexes": ("table_name", "index_name"),
    "q11_proc_ranking": ("proc_name",),
    "q12a_trigger_cpu": ("trigger_name",),
    "q12b_trigger_inventory": ("trigger_name",),
    "q13a_qs_capacity": ("server_id",),
    "q13b_qs_top_duration": ("query_id",),
    "q13c_plan_regression_pairs": ("plan_id", "recent_id", "history_id"),
    "q14a_memory_grants": ("session_id",),
    "q14b_grant_summary": ("server_id",),
    "q15a_temp_space": ("server_id",),
    "q15b_temp_by_session": ("session_id", "request_id"),
    "q16a_process_memory": ("server_id",),
    "q16b_page_life": ("server_id",),
    "q16c_memory_cap": ("server_id",),
    "q16d_buffer_by_db": ("database_id",),
    "q17a_file_latency": ("file_name",),
    "q17b_volume_space": ("mount_point",),
    "q18_stale_stats": ("table_name", "stats_name"),
    "q19a_cached_plans": ("plan_handle",),
    "q19b_single_use_ratio": ("objtype",),
    "q20a_backup_age": ("database_name",),
    "q20b_log_reuse": ("name",),
    "q20c_log_vs_data": ("name",),
    "q21_integrity_age": ("name",),
    "q22_job_failures": ("job", "instance_id"),
    "q23a_config_audit": ("name",),
    "q23b_database_options": ("name",),
    "q23c_server_uptime": ("server_id",),
    "q24a_vlf_by_db": ("database_name",),
    "q24b_vlf_size": ("database_id",),
    "q25_autogrowth": ("file_name",),
    "q26d_hourly_history": ("day", "hour"),
    "q28e_index_usage_delta": ("table_name", "index_name"),
    "q28f_fragmentation_delta": ("table_name", "index_name"),
    "q28g_wait_change": ("wait_type",),
    "q28h_qs_reads_impact": ("query_id",),
    "q29a_grant_queue": ("session_id",),
    "q29b_wait_actions": ("wait_type",),
    "q29c_qs_recent": ("query_id",),
    "q30a_stats_diagnosis": ("table_name", "stats_name"),
    "q30e_filtered_stats": ("table_name", "stats_name"),
    "q31a_backup_growth": ("backup_set_id",),
    "q31b_monthly_size": ("database_name", "year", "month"),
    "q32a_availability": ("server_id",),
    "q33_io_share": ("database_name",),
    "q34a_regressions": ("query_id",),
    "x16_parameter_spread": ("query_id",),
}
# Reports whose column "name" is the database's.
NAMED_DATABASES = ("q20b_log_reuse", "q20c_log_vs_data", "q21_integrity_age", "q23b_database_options")
# Priority by severity: up to 10 act now, up to 50 plan, up to 200 note.
PRIORITIES = {
    "CRITICAL": 1, "REMOVE": 10, "REBUILD": 10, "CREATE": 10, "ATTENTION": 11,
    "REORGANIZE": 50, "EVALUATE": 50, "VERIFY": 50, "LOW": 200, "OK": 200,
}


def priority() -> Column:
    pairs = [F.lit(v) for pair in PRIORITIES.items() for v in pair]
    return F.coalesce(F.create_map(*pairs)[F.col("severity")], F.lit(200))


def band() -> Column:
    return F.when(F.col("priority") <= 10, "act_now").when(F.col("priority") <= 50, "plan").otherwise("note")


def as_findings(report: DataFrame, name: str, entity) -> DataFrame:
    """Rows of one report in the common shape, with the database's name or, where it has none, its id."""

    def known(column: str, kind: str) -> Column:
        return (F.col(column) if column in report.columns else F.lit(None)).cast(kind)

    database = F.col("name") if name in NAMED_DATABASES else known("database_name", "string")
    by_id = F.lit(None).cast("bigint") if "database_name" in report.columns else known("database_id", "bigint")
    return report.select(
        F.col("server_id").cast("bigint").alias("server_id"), known("snapshot_ts", "timestamp").alias("snapshot_ts"),
        F.lit(name).alias("report"), database.alias("database"), by_id.alias("database_id"),
        F.concat_ws("/", *[F.col(c).cast("string") for c in entity]).alias("entity"), "severity", "reason",
    )


def store_findings(
    t: Telemetry, reports: dict[str, Callable[[Telemetry], DataFrame]], path: str, at_once: int = 8
) -> DataFrame:
    """Run the graded reports, some at a time, and keep their findings in one table by report.

    A report written again replaces its own part only. Feeds read the table and run no report.
    """
    names = [name for name in ENTITIES if name in reports]

    def write(name: str) -> None:
        rows = as_findings(reports[name](t), name, ENTITIES[name]).drop("report")
        rows.write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/report={name}")

    with ThreadPoolExecutor(at_once) as pool:
        list(pool.map(write, names))
    return t.spark.read.schema(STORED).parquet(path)


STORED = (
    "server_id bigint, snapshot_ts timestamp, database string, database_id bigint, entity string, severity string, "
    "reason string, report string"
)


def findings_feed(
    t: Telemetry, reports: dict[str, Callable[[Telemetry], DataFrame]] | DataFrame,
    max_priority: int | None = None, server_id: int | None = None, databases=None,
) -> DataFrame:
    """All findings, or those up to a priority, of one server or of some databases by name.

    ``reports`` are the reports to run, or the table that store_findings wrote. Databases
    that a report knows by id only are named by one lookup. The predicate on the server
    reaches each scan.
    """
    if isinstance(reports, DataFrame):
        feed = reports
    else:
        feed = reduce(
            DataFrame.unionByName, [as_findings(reports[name](t), name, entity) for name, entity in ENTITIES.items() if name in reports]
        )
    if server_id is not None:
        feed = feed.where(F.col("server_id") == server_id)
    feed = with_database(feed, t).select(
        "server_id", "snapshot_ts", "report", F.coalesce("database", "database_name").alias("database"), "entity",
        "severity", "reason", priority().alias("priority"),
    )
    if databases is not None:
        feed = feed.where(F.col("database").isin(*databases))
    if max_priority is not None:
        feed = feed.where(F.col("priority") <= max_priority)
    return feed.withColumn("band", band())
