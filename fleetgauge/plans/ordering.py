"""The row order each report is read in.

Reports return their rows unordered: a global sort is one more shuffle, and most
consumers store or filter them. ``ordered`` sorts for reading, server by server.
Nulls sort low, first when ascending and last when descending.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A leading minus means descending.
ORDERS = {
    "q02_activity_log_latest": ("-collection_time",),
    "q04d_wait_delta": ("-delta_wait_ms", "wait_type"),
    "q06_blocking_pairs": ("-wait_seconds", "blocked_session_id"),
    "q07a_session_groups": ("-connections",),
    "q07b_idle_sessions": ("-idle_minutes", "session_id"),
    "q07c_connections_per_db": ("-connections",),
    "q09a_fragmentation": ("-fragmentation_pct", "table_name", "index_name"),
    "q09b_maintenance_log": ("-start_time",),
    "q10_unused_indexes": ("seeks", "-updates"),
    "q12b_trigger_inventory": ("parent_table", "trigger_name"),
    "q14a_memory_grants": ("-requested_mb", "session_id"),
    "q16d_buffer_by_db": ("-cached_mb",),
    "q17a_file_latency": ("-avg_read_ms", "file_id"),
    "q17b_volume_space": ("free_pct", "mount_point"),
    "q18_stale_stats": ("-modification_counter", "stats_name"),
    "q19b_single_use_ratio": ("-plans",),
    "q20a_backup_age": ("-hours_since_full", "database_name"),
    "q20b_log_reuse": ("name",),
    "q20c_log_vs_data": ("-log_mb", "name"),
    "q21_integrity_age": ("-days_since_check", "name"),
    "q22_job_failures": ("-executed_at", "instance_id"),
    "q23a_config_audit": ("name",),
    "q23b_database_options": ("name",),
    "q24a_vlf_by_db": ("-segments",),
    "q25_autogrowth": ("sort_bucket", "database_id", "file_name"),
    "q26d_hourly_history": ("day", "hour"),
    "q27_maintenance_log": ("-start_time",),
    "q28a_capture_index_usage": ("table_name", "index_name"),
    "q28b_capture_fragmentation": ("table_name", "index_name"),
    "q28c_capture_waits": ("-wait_time_ms",),
    "q28e_index_usage_delta": ("-delta_seeks", "table_name", "index_name"),
    "q28f_fragmentation_delta": ("-delta_page_splits", "table_name", "index_name"),
    "q28g_wait_change": ("-delta_ms", "wait_type"),
    "q29a_grant_queue": ("-requested_mb", "session_id"),
    "q30a_stats_diagnosis": ("sort_bucket", "-modification_counter", "stats_name"),
    "q30e_filtered_stats": ("table_name", "stats_name"),
    "q31a_backup_growth": ("database_name", "-backup_finish_date", "backup_set_id"),
    "q31b_monthly_size": ("database_name", "-year", "-month"),
    "q33_io_share": ("-reads", "database_id"),
    "q34b_plan_list": ("query_id", "plan_order"),
}


def ordered(name: str, report: DataFrame) -> DataFrame:
    """A report in reading order: by server and snapshot, then its own order or its rank."""
    leading = [c for c in ("server_id", "snapshot_ts") if c in report.columns]
    own = ORDERS.get(name, ("rank",) if "rank" in report.columns else ())
    if own and own[0].lstrip("-") in ("collection_time", "start_time"):
        leading = []  # logs read across servers
    return report.orderBy(*leading, *[F.desc(c[1:]) if c.startswith("-") else F.asc(c) for c in own])
