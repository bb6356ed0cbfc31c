from __future__ import annotations

from fleetgauge.oracles.common import CAPTURES, EVENTS_NOW, READINGS, case, days, exports, pct, rdiv, sql

QN = "'[' || replace({0}, ']', ']]') || ']'"
SCORE = "CAST(s.avg_total_user_cost * s.avg_user_impact * (s.user_seeks + s.user_scans) AS BIGINT)"
# Fixed value: the options of the index command.
OPTIONS = "FILLFACTOR=90, ONLINE=OFF, SORT_IN_TEMPDB=ON"
CREATE = f"""'CREATE NONCLUSTERED INDEX IX_' || d.table_name || '_' || replace(replace(coalesce(d.equality_columns, ''), '[', ''), ']', '')
 || CASE WHEN d.inequality_columns IS NOT NULL THEN '_' || replace(replace(d.inequality_columns, '[', ''), ']', '') ELSE '' END
 || ' ON ' || d.table_name || ' (' || coalesce(d.equality_columns, '')
 || CASE WHEN d.equality_columns IS NOT NULL AND d.inequality_columns IS NOT NULL THEN ', ' ELSE '' END
 || coalesce(d.inequality_columns, '') || ')' || coalesce(' INCLUDE (' || d.included_columns || ')', '')
 || ' WITH ({OPTIONS})'"""
MISSING = f"""SELECT *, {case(("score > 100000 AND benefit_pct > 70", "CREATE", "high_impact"),
  ("score > 10000", "EVALUATE", "moderate_impact"), otherwise=("LOW", "low_priority"))} FROM (
 SELECT d.server_id, d.database_id, row_number() OVER (PARTITION BY d.server_id, d.database_id
   ORDER BY {SCORE} DESC, d.index_handle) AS rank, {SCORE} AS score, s.avg_user_impact AS benefit_pct, s.user_seeks, s.user_scans,
  d.table_name, d.equality_columns, d.inequality_columns, d.included_columns, {CREATE} AS create_command
 FROM missing_index_group g JOIN missing_index_stats s ON s.server_id = g.server_id AND s.group_handle = g.index_group_handle
 JOIN missing_index_detail d ON d.server_id = g.server_id AND d.index_handle = g.index_handle) y WHERE rank <= 30"""
FRAGMENTED = f"""SELECT p.server_id, p.database_id, i.table_name, i.index_name, {rdiv('p.fragmentation_tenths', '10', 1)} AS fragmentation_pct,
 p.page_count, {rdiv('p.page_count * 8', '1024', 1)} AS size_mb,
 {case(("p.fragmentation_tenths > 300", "REBUILD", "critical_fragmentation"),
  ("p.fragmentation_tenths > 100", "REORGANIZE", "moderate_fragmentation"))}
 FROM index_physical p JOIN index_dim i ON i.server_id = p.server_id AND i.database_id = p.database_id AND i.index_id = p.index_id
 WHERE p.fragmentation_tenths > 100 AND p.page_count > 100 AND i.index_name IS NOT NULL"""


def _z(column: str) -> str:
    return f"coalesce(u.user_{column}, 0)"


UNUSED = f"""SELECT i.server_id, i.database_id, i.table_name, i.index_name, {_z('seeks')} AS seeks, {_z('scans')} AS scans,
 {_z('lookups')} AS lookups, {_z('updates')} AS updates, u.last_user_seek,
 {rdiv(_z('seeks'), 'u.user_updates', 2)} AS seeks_per_update,
 (SELECT start_time FROM server_info v WHERE v.server_id = i.server_id) AS counters_since,
 'DROP INDEX ' || {QN.format('i.index_name')} || ' ON ' || {QN.format('i.table_name')} AS drop_command,
 {case(("u.index_id IS NULL", "ATTENTION", "no_usage_since_restart"),
  (f"{_z('seeks')} = 0 AND {_z('scans')} = 0 AND {_z('lookups')} = 0 AND {_z('updates')} > 10000", "REMOVE", "write_cost_only"),
  (f"{_z('lookups')} > 10000", "ATTENTION", "many_lookups"), (f"{_z('seeks')} > 1000", "OK", "well_used"),
  (f"{_z('seeks')} > 100", "OK", "used"), otherwise=("ATTENTION", "little_used"))}
 FROM index_dim i LEFT JOIN index_usage u ON u.server_id = i.server_id AND u.index_id = i.index_id
 WHERE i.type_desc <> 'HEAP' AND i.is_primary_key = 0 AND i.is_unique_constraint = 0 AND i.is_disabled = 0"""
MISSING_TABLES = ("missing_index_group", "missing_index_stats", "missing_index_detail")
STALE = f"last_updated < {EVENTS_NOW} - INTERVAL 7 DAY"
OLD = f"last_updated < {EVENTS_NOW} - INTERVAL 14 DAY"
UPDATE = f"'UPDATE STATISTICS ' || {QN.format('table_name')} || ' ' || {QN.format('stats_name')}"
MODE = "CASE WHEN {0} > 10000000 THEN 'SAMPLE 30 PERCENT' ELSE 'FULLSCAN' END"
M, R, S = "modification_counter", "total_rows", "rows_sampled"
THIN = f"{S} * 1.0 / nullif({R}, 0) < 0.10"


def usage_capture(phase: str, table: str) -> str:
    return f"""SELECT '{phase}' AS phase, {EVENTS_NOW} AS captured_at, i.server_id, i.database_id, i.table_name, i.index_name,
 {_z('seeks')} AS seeks, {_z('scans')} AS scans, {_z('lookups')} AS lookups, {_z('updates')} AS updates,
 (SELECT start_time FROM server_info v WHERE v.server_id = i.server_id) AS counters_since
 FROM index_dim i LEFT JOIN {table} u ON u.server_id = i.server_id AND u.index_id = i.index_id
 WHERE i.type_desc <> 'HEAP' AND i.is_disabled = 0"""


def frag_capture(phase: str, suffix: str) -> str:
    return f"""SELECT '{phase}' AS phase, {EVENTS_NOW} AS captured_at, i.server_id, i.database_id, i.table_name, i.index_name,
 {rdiv('p.fragmentation_tenths', '10', 1)} AS fragmentation_pct, p.page_count, p.record_count,
 CAST(coalesce((SELECT sum(o.leaf_allocation_count) FROM index_operational{suffix} o WHERE o.server_id = p.server_id
   AND o.index_id = p.index_id), 0) AS BIGINT) AS page_splits
 FROM index_physical{suffix} p JOIN index_dim i ON i.server_id = p.server_id AND i.database_id = p.database_id AND i.index_id = p.index_id
 WHERE p.page_count > 1000 AND i.index_name IS NOT NULL"""


def wait_capture(phase: str, table: str) -> str:
    return f"""SELECT '{phase}' AS phase, {EVENTS_NOW} AS captured_at, server_id, wait_type, wait_time_ms, waiting_tasks_count AS waiting_tasks
 FROM {table} WHERE wait_type IN ('PAGEIOLATCH_SH', 'PAGEIOLATCH_EX', 'WRITELOG', 'LCK_M_S', 'LCK_M_X', 'LCK_M_U', 'CXPACKET')
 AND wait_time_ms > 0"""


def usage_case() -> str:
    return case(
        ("delta_seeks > 1000 AND delta_lookups < 1000", "OK", "works_well"), ("delta_seeks > 100", "OK", "used"),
        ("delta_lookups > 10000", "ATTENTION", "many_lookups"), ("delta_scans > delta_seeks AND delta_scans > 1000", "ATTENTION", "scans_dominate"),
        ("delta_seeks = 0 AND delta_updates > 0", "CRITICAL", "write_cost_only"), ("delta_seeks = 0 AND delta_updates = 0", "ATTENTION", "no_activity"),
        otherwise=("ATTENTION", "little_used"),
    )


def wait_change_case() -> str:
    return case(
        ("wait_type IN ('PAGEIOLATCH_SH', 'PAGEIOLATCH_EX') AND delta_ms < 0", "OK", "io_improved"),
        ("wait_type = 'CXPACKET' AND delta_ms < 0", "OK", "parallelism_reduced"),
        ("wait_type IN ('PAGEIOLATCH_SH', 'PAGEIOLATCH_EX') AND delta_ms > 0", "ATTENTION", "io_worse"),
        ("wait_type = 'WRITELOG' AND delta_ms > 0", "ATTENTION", "log_grew"),
        ("wait_type LIKE 'LCK_M_%' AND delta_ms > 0", "ATTENTION", "lock_contention_grew"), otherwise=("OK", "no_significant_change"),
    )


def exported_usage(table: str, readings) -> str:
    """Counts of every enabled index in every snapshot of its server, zero where a snapshot has no row for it."""
    rows = exports(table, ("user_seeks", "user_scans", "user_lookups", "user_updates"), readings)
    counts = ", ".join(f"coalesce(u.user_{k}, 0) AS {k}" for k in ("seeks", "scans", "lookups", "updates"))
    return f"""(SELECT i.server_id, i.database_id, i.table_name, i.index_name, s.snapshot_ts, {counts}
 FROM index_dim i JOIN (SELECT DISTINCT server_id, snapshot_ts FROM {rows} r) s ON s.server_id = i.server_id
 LEFT JOIN {rows} u ON u.server_id = i.server_id AND u.index_id = i.index_id AND u.snapshot_ts = s.snapshot_ts
 WHERE i.type_desc <> 'HEAP' AND i.is_disabled = 0)"""


SAME_INDEX = " AND ".join(f"d.{k} = a.{k}" for k in ("server_id", "database_id", "table_name", "index_name"))
D = "d.{0} - a.{0}"
ORACLES = {
    "q08_missing_indexes": sql(MISSING, *MISSING_TABLES),
    "q09a_fragmentation": sql(FRAGMENTED, "index_physical", "index_dim"),
    "q10_unused_indexes": sql(UNUSED, "index_dim", "index_usage", "server_info"),
    "x07_index_review": sql(f"""
SELECT server_id, database_id, 'missing_index' AS finding, table_name, CAST(NULL AS VARCHAR) AS index_name, severity, reason FROM ({MISSING}) a
UNION ALL SELECT server_id, database_id, 'fragmentation', table_name, index_name, severity, reason FROM ({FRAGMENTED}) b
UNION ALL SELECT server_id, database_id, 'index_usage', table_name, index_name, severity, reason FROM ({UNUSED}) c""",
        *MISSING_TABLES, "index_physical", "index_dim", "index_usage", "server_info"),
    "x08_maintenance_plan": sql(f"""
SELECT p.server_id, p.database_id, i.table_name, i.index_name, p.page_count, {rdiv('p.fragmentation_tenths', '10', 1)} AS fragmentation_pct,
 CASE WHEN p.page_count >= 100 AND p.fragmentation_tenths >= 300 THEN 'REBUILD'
  WHEN p.page_count >= 100 AND p.fragmentation_tenths >= 100 THEN 'REORGANIZE' ELSE 'NONE' END AS index_action,
 CASE WHEN s.modification_counter > 0 THEN 'UPDATE_STATISTICS' ELSE 'NONE' END AS stats_action, {MODE.format('s.total_rows')} AS scan_mode
FROM index_physical p JOIN index_dim i ON i.server_id = p.server_id AND i.database_id = p.database_id AND i.index_id = p.index_id
LEFT JOIN stats_properties s ON s.server_id = p.server_id AND s.database_id = p.database_id AND s.stats_id = p.index_id
WHERE i.index_name IS NOT NULL""", "index_physical", "index_dim", "stats_properties"),
    "x17_safe_drop_gate": sql(f"""
SELECT *, CASE WHEN severity = 'REMOVE' AND observed_days >= 31 THEN 1 ELSE 0 END AS drop_allowed,
 CASE WHEN severity <> 'REMOVE' THEN 'not_a_candidate' WHEN observed_days >= 31 THEN 'observed_full_cycle' ELSE 'wait_for_full_cycle' END AS gate
FROM (SELECT server_id, database_id, table_name, index_name, severity, reason, {days('counters_since', EVENTS_NOW)} AS observed_days
 FROM ({UNUSED}) u) y""", "index_dim", "index_usage", "server_info"),
    "q18_stale_stats": sql(f"""
SELECT server_id, database_id, table_name, stats_name, last_updated, total_rows, modification_counter, {pct(M, R, 1)} AS changed_pct,
 {UPDATE} || ' WITH FULLSCAN' AS update_command, {MODE.format(R)} AS scan_mode,
 {case((f"{M} > {R} * 0.20", "CRITICAL", "changed_over_20_pct"), (f"{M} > {R} * 0.10", "ATTENTION", "changed_over_10_pct"),
  (f"{M} > 10000", "ATTENTION", "many_changes"), (STALE, "ATTENTION", "older_than_7d"))}
FROM stats_properties WHERE {R} > 0 AND ({M} > 1000 OR {STALE})""", "stats_properties"),
    "q30a_stats_diagnosis": sql(f"""
SELECT server_id, database_id, table_name, stats_name, has_filter, filter_definition, last_updated, total_rows, rows_sampled,
 {pct(S, R, 1)} AS sampled_pct, steps, modification_counter, {pct(M, R, 1)} AS changed_pct, {UPDATE} AS update_command,
 {UPDATE} || ' WITH FULLSCAN' AS full_scan_command,
 CASE WHEN {M} > {R} * 0.20 THEN 1 WHEN {M} > {R} * 0.10 THEN 2 WHEN {THIN} THEN 3 ELSE 4 END AS sort_bucket,
 {case((f"{M} > {R} * 0.30", "CRITICAL", "changed_over_30_pct"), (f"{M} > {R} * 0.20", "CRITICAL", "changed_over_20_pct"),
  (f"{M} > {R} * 0.10", "ATTENTION", "changed_over_10_pct"), (f"{THIN} AND {R} > 100000", "ATTENTION", "thin_sample"),
  (f"steps < 10 AND {R} > 50000", "ATTENTION", "few_steps"), (OLD, "ATTENTION", "older_than_14d"))}
FROM stats_properties WHERE {R} > 1000 AND ({M} > {R} * 0.10 OR {THIN} OR steps < 10 OR {OLD})""", "stats_properties"),
    "q30e_filtered_stats": sql(f"""
SELECT server_id, database_id, table_name, stats_name, filter_definition, last_updated, total_rows, steps,
 {case((STALE, "ATTENTION", "filtered_statistics_old"))} FROM stats_properties WHERE has_filter = 1""", "stats_properties"),
    "x20_updatestats_scope": sql("""
SELECT server_id, database_id, table_name, stats_name, modification_counter, total_rows FROM stats_properties
WHERE modification_counter > 0""", "stats_properties"),
    "q35_rows_per_table": sql("""
SELECT server_id, table_name, CAST(sum(row_count) AS BIGINT) AS row_count FROM partition_rows GROUP BY ALL""", "partition_rows"),
    "x18_scan_mode_gate": sql(f"""
SELECT server_id, table_name, row_count, {MODE.format('row_count')} AS scan_mode FROM (
 SELECT server_id, table_name, CAST(sum(row_count) AS BIGINT) AS row_count FROM partition_rows GROUP BY ALL) y""", "partition_rows"),
    "q28a_capture_index_usage": sql(usage_capture("before", "index_usage_earlier"), "index_dim", "index_usage_earlier", "server_info"),
    "q28b_capture_fragmentation": sql(frag_capture("before", "_earlier"), "index_physical_earlier", "index_operational_earlier", "index_dim"),
    "q28c_capture_waits": sql(wait_capture("before", "wait_snapshot_earlier"), "wait_snapshot_earlier"),
    "q28d_capture_after": sql(usage_capture("7d", "index_usage"), "index_dim", "index_usage", "server_info"),
    "q28e_index_usage_delta": sql(f"""
WITH a AS ({usage_capture("before", "index_usage_earlier")}), d AS ({usage_capture("7d", "index_usage")})
SELECT *, {rdiv('delta_seeks', 'delta_updates', 2)} AS seeks_per_update,
 {usage_case()}
FROM (SELECT d.server_id, d.database_id, d.table_name, d.index_name, {D.format('seeks')} AS delta_seeks, {D.format('scans')} AS delta_scans,
 {D.format('lookups')} AS delta_lookups, {D.format('updates')} AS delta_updates FROM d JOIN a ON {SAME_INDEX}) y""",
        "index_dim", "index_usage", "index_usage_earlier", "server_info"),
    "q28f_fragmentation_delta": sql(f"""
WITH a AS ({frag_capture("before", "_earlier")}), d AS ({frag_capture("7d", "")})
SELECT *, {case(("delta_page_splits > 10000", "CRITICAL", "many_page_splits"), ("after_pct > 30 AND page_count > 1000", "CRITICAL", "rebuild_needed"),
  ("after_pct BETWEEN 10 AND 30", "ATTENTION", "reorganize"))}
FROM (SELECT d.server_id, d.database_id, d.table_name, d.index_name, a.fragmentation_pct AS before_pct, d.fragmentation_pct AS after_pct,
 round((d.fragmentation_pct - a.fragmentation_pct) * 10) / 10 AS delta_pct, {D.format('page_splits')} AS delta_page_splits, d.page_count
 FROM d JOIN a ON {SAME_INDEX}) y""",
        "index_physical", "index_operational", "index_physical_earlier", "index_operational_earlier", "index_dim"),
    "q28g_wait_change": sql(f"""
WITH a AS ({wait_capture("before", "wait_snapshot_earlier")}), d AS ({wait_capture("7d", "wait_snapshot")})
SELECT *, {pct('delta_ms', 'before_ms', 1)} AS change_pct,
 {wait_change_case()}
FROM (SELECT d.server_id, d.wait_type, a.wait_time_ms AS before_ms, d.wait_time_ms AS after_ms, d.wait_time_ms - a.wait_time_ms AS delta_ms
 FROM d JOIN a ON d.server_id = a.server_id AND d.wait_type = a.wait_type) y""", "wait_snapshot", "wait_snapshot_earlier"),
    "q28i_index_usage_exports": sql(f"""
SELECT *, {rdiv('delta_seeks', 'delta_updates', 2)} AS seeks_per_update, {usage_case()}
FROM (SELECT d.server_id, d.snapshot_ts, d.database_id, d.table_name, d.index_name, {D.format('seeks')} AS delta_seeks, {D.format('scans')} AS delta_scans,
 {D.format('lookups')} AS delta_lookups, {D.format('updates')} AS delta_updates
 FROM {exported_usage("index_usage", READINGS)} d JOIN {exported_usage("index_usage_earlier", CAPTURES)} a ON {SAME_INDEX} AND a.snapshot_ts <= d.snapshot_ts
 QUALIFY row_number() OVER (PARTITION BY d.server_id, d.database_id, d.table_name, d.index_name, d.snapshot_ts ORDER BY a.snapshot_ts DESC) = 1) y""",
        "index_dim", "index_usage", "index_usage_earlier"),
    "q28j_wait_change_exports": sql(f"""
SELECT *, {pct('delta_ms', 'before_ms', 1)} AS change_pct, {wait_change_case()}
FROM (SELECT d.server_id, d.snapshot_ts, d.wait_type, a.wait_time_ms AS before_ms, d.wait_time_ms AS after_ms, d.wait_time_ms - a.wait_time_ms AS delta_ms
 FROM {exports("wait_snapshot", ("wait_time_ms",), READINGS)} d JOIN {exports("wait_snapshot_earlier", ("wait_time_ms",), CAPTURES)} a
  ON d.server_id = a.server_id AND d.wait_type = a.wait_type AND a.snapshot_ts <= d.snapshot_ts
 WHERE d.wait_type IN ('PAGEIOLATCH_SH', 'PAGEIOLATCH_EX', 'WRITELOG', 'LCK_M_S', 'LCK_M_X', 'LCK_M_U', 'CXPACKET') AND d.wait_time_ms > 0 AND a.wait_time_ms > 0
 QUALIFY row_number() OVER (PARTITION BY d.server_id, d.wait_type, d.snapshot_ts ORDER BY a.snapshot_ts DESC) = 1) y""",
        "wait_snapshot", "wait_snapshot_earlier"),
}
