"""All check statements by report name."""

from __future__ import annotations

from fleetgauge.oracles.common import inline
from fleetgauge.plans.findings import ENTITIES
from fleetgauge.oracles import column_stats, history, indexes, servers, sessions, storage, streaming, waiting, workload

ORACLES: dict[str, str] = {
    **sessions.ORACLES, **waiting.ORACLES, **servers.ORACLES, **storage.ORACLES,
    **workload.ORACLES, **indexes.ORACLES, **history.ORACLES, **column_stats.ORACLES,
    **streaming.ORACLES,
}


SNAPSHOTS = (
    "q03_active_requests", "q06_blocking_pairs", "q07a_session_groups", "q07b_idle_sessions", "q07c_connections_per_db",
    "q14a_memory_grants", "q14b_grant_summary", "q15b_temp_by_session", "q29a_grant_queue",
)
NAMES = ("q20b_log_reuse", "q20c_log_vs_data", "q21_integrity_age", "q23b_database_options")
DATABASE_NAMES = (
    "q03_active_requests", "q04a_query_cpu", "q04b_proc_cpu", "q06_blocking_pairs", "q07c_connections_per_db", "q09b_maintenance_log",
    "q11_proc_ranking", "q12a_trigger_cpu", "q15b_temp_by_session", "q16d_buffer_by_db", "q19a_cached_plans", "q20a_backup_age", "q24a_vlf_by_db",
    "q31a_backup_growth", "q31b_monthly_size", "q33_io_share",
)
DATABASE_IDS = (
    "q08_missing_indexes", "q09a_fragmentation", "q10_unused_indexes", "q12b_trigger_inventory", "q14a_memory_grants",
    "q17a_file_latency", "q18_stale_stats", "q24b_vlf_size", "q25_autogrowth", "q28e_index_usage_delta", "q28f_fragmentation_delta",
    "q30a_stats_diagnosis", "q30e_filtered_stats",
)


def _feed() -> str:
    parts = []
    for name, entity in ENTITIES.items():
        label = ", ".join(f"CAST(r.{c} AS VARCHAR)" for c in entity)
        database = "r.name" if name in NAMES else "r.database_name" if name in DATABASE_NAMES else "d.name" if name in DATABASE_IDS else "NULL"
        dim = "LEFT JOIN dbs d ON d.server_id = r.server_id AND d.database_id = r.database_id" if name in DATABASE_IDS else ""
        parts.append(
            f"SELECT r.server_id, {'r.snapshot_ts' if name in SNAPSHOTS else 'CAST(NULL AS TIMESTAMP)'} AS snapshot_ts, '{name}' AS report, "
            f"CAST({database} AS VARCHAR) AS database, concat_ws('/', {label}) AS entity, r.severity, r.reason FROM ({ORACLES[name]}) r {dim}"
        )
    return (
        f"WITH dbs AS ({inline('database_dim')}) SELECT *, CASE WHEN priority <= 10 THEN 'act_now' WHEN priority <= 50 THEN 'plan' ELSE 'note' END AS band FROM ("
        "SELECT *, CAST(CASE WHEN severity = 'CRITICAL' THEN 1 WHEN severity IN ('REMOVE', 'REBUILD', 'CREATE') THEN 10 WHEN severity = 'ATTENTION' THEN 11 "
        f"WHEN severity IN ('REORGANIZE', 'EVALUATE', 'VERIFY') THEN 50 ELSE 200 END AS INT) AS priority FROM ({' UNION ALL '.join(parts)}) u) y"
    )


ORACLES["x01_findings_feed"] = _feed()
ORACLES["x06b_deadlock_counts"] = (
    "SELECT server_id, count(DISTINCT (snapshot_ts, first_session_id)) AS events, count(*) AS sessions "
    f"FROM ({ORACLES['x06_deadlock_window']}) m GROUP BY server_id"
)
# Requests are sampled twice, half an hour apart, and every deadlock is in both samples.
ORACLES["x06c_deadlock_events"] = (
    "SELECT server_id, first_session_id, count(*) AS sessions, string_agg(CAST(session_id AS VARCHAR), ',' ORDER BY session_id) AS members, "
    "snapshot_ts AS started, snapshot_ts + INTERVAL 30 MINUTE AS ended, CAST(2 AS BIGINT) AS snapshots "
    f"FROM ({ORACLES['x06_deadlock_window']}) m GROUP BY server_id, first_session_id, snapshot_ts"
)
