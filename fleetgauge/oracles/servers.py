from __future__ import annotations

from fleetgauge.oracles.common import EVENTS_NOW, big, case, days, hours, idiv, mb, sql
from fleetgauge.oracles.sessions import DB

DAYS = days("start_time", EVENTS_NOW)
HOURS = hours("start_time", EVENTS_NOW)
# The audited settings.
SETTINGS = (
    "'max server memory (MB)', 'min server memory (MB)', 'max degree of parallelism', "
    "'cost threshold for parallelism', 'optimize for ad hoc workloads', 'xp_cmdshell', "
    "'backup compression default', 'remote admin connections'"
)
SAME_SESSION = "{0}.server_id = {1}.server_id AND {0}.snapshot_ts = {1}.snapshot_ts AND {0}.session_id = {1}.session_id"
CAP = "(SELECT c.value_in_use FROM server_config c WHERE c.server_id = m.server_id AND c.name = 'max server memory (MB)')"

ORACLES = {
    "q01_uptime_confidence": sql(f"""
SELECT *, {case(("days_up < 1", "ATTENTION", "waits_not_accumulated"), ("days_up < 7", "OK", "waits_reliable"),
  otherwise=("OK", "use_deltas"))} FROM (SELECT server_id, start_time, {DAYS} AS days_up FROM server_info) y""", "server_info"),
    "q23c_server_uptime": sql(f"""
SELECT server_id, cpu_count, {idiv(idiv('physical_memory_kb', 1024), 1024)} AS ram_gb, start_time, {DAYS} AS days_up,
 {case((f"{HOURS} < 24", "ATTENTION", "restarted_within_24h"), (f"{DAYS} < 7", "ATTENTION", "restarted_within_7d"))}
FROM server_info""", "server_info"),
    "q32a_availability": sql(f"""
SELECT *, {case(("hours_up < 1", "CRITICAL", "restarted_within_1h"), ("hours_up < 24", "ATTENTION", "restarted_within_24h"),
  ("days_up < 7", "ATTENTION", "restarted_within_7d"))}, {case(("hours_up < 24", "ATTENTION", "counters_incomplete"),
  otherwise=("OK", "counters_sufficient"), names=("counter_severity", "counter_reason"))}
FROM (SELECT server_id, start_time AS last_restart, {EVENTS_NOW} AS as_of, {HOURS} AS hours_up, {DAYS} AS days_up
 FROM server_info) y""", "server_info"),
    "q14a_memory_grants": sql(f"""
SELECT m.server_id, m.snapshot_ts, m.session_id, r.database_id, m.grant_time,
 {idiv('m.requested_memory_kb', 1024)} AS requested_mb, {idiv('m.granted_memory_kb', 1024)} AS granted_mb,
 {idiv('m.used_memory_kb', 1024)} AS used_mb, m.queue_id, m.wait_time_ms, substring(x.text, 1, 200) AS query,
 d.name AS database_name, {case(("m.grant_time IS NULL", "CRITICAL", "waiting_for_memory"),
  ("m.used_memory_kb < m.granted_memory_kb * 0.3", "ATTENTION", "grant_wasted"))}
FROM memory_grant m JOIN request_snapshot r ON {SAME_SESSION.format('m', 'r')}
JOIN sql_text x ON x.sql_handle = r.sql_handle {DB.format('r')}""",
        "memory_grant", "request_snapshot", "sql_text", "database_dim"),
    "q14b_grant_summary": sql(f"""
SELECT *, {case(("waiting > 5", "CRITICAL", "long_grant_queue"), ("waiting > 0", "ATTENTION", "queries_waiting"))} FROM (
 SELECT server_id, snapshot_ts, {idiv('sum(granted_memory_kb)', 1024)} AS granted_mb,
  {idiv('sum(used_memory_kb)', 1024)} AS used_mb, count(*) AS grants,
  {big('sum(CASE WHEN grant_time IS NULL THEN 1 ELSE 0 END)')} AS waiting
 FROM memory_grant GROUP BY ALL) y""", "memory_grant"),
    "q29a_grant_queue": sql(f"""
SELECT server_id, snapshot_ts, session_id, {idiv('requested_memory_kb', 1024)} AS requested_mb,
 {idiv('granted_memory_kb', 1024)} AS granted_mb, wait_time_ms, queue_id,
 {case(("grant_time IS NULL", "CRITICAL", "waiting_for_memory"), otherwise=("OK", "granted"))} FROM memory_grant""",
        "memory_grant"),
    "q15a_temp_space": sql(f"""
SELECT *, {case(("internal_mb > 1000", "CRITICAL", "spills"), ("version_mb > 500", "ATTENTION", "version_store"),
  ("user_mb > 2000", "ATTENTION", "temporary_tables"))} FROM (
 SELECT server_id, {mb('sum(user_pages)')} AS user_mb, {mb('sum(internal_pages)')} AS internal_mb,
  {mb('sum(version_pages)')} AS version_mb, {mb('sum(free_pages)')} AS free_mb
 FROM temp_file_space GROUP BY ALL) y""", "temp_file_space"),
    "q15b_temp_by_session": sql(f"""
SELECT *, {case(("internal_mb > 500", "CRITICAL", "spill_over_500mb"), ("total_mb > 200", "ATTENTION", "high_use"))} FROM (
 SELECT k.server_id, k.snapshot_ts, k.session_id, k.request_id, s.login_name, s.host_name, s.program_name, r.wait_type,
  {mb('k.user_pages')} AS user_mb, {mb('k.internal_pages')} AS internal_mb,
  {mb('k.user_pages + k.internal_pages')} AS total_mb, substring(x.text, 1, 200) AS query, d.name AS database_name,
  row_number() OVER (PARTITION BY k.server_id, k.snapshot_ts
   ORDER BY {mb('k.user_pages + k.internal_pages')} DESC, k.session_id, k.request_id) AS rank
 FROM temp_task_space k JOIN session_snapshot s ON {SAME_SESSION.format('k', 's')}
 LEFT JOIN request_snapshot r ON {SAME_SESSION.format('k', 'r')} AND k.request_id = r.request_id
 LEFT JOIN sql_text x ON x.sql_handle = r.sql_handle {DB.format('r')}
 WHERE k.user_pages > 0 OR k.internal_pages > 0) y WHERE rank <= 20""",
        "temp_task_space", "session_snapshot", "request_snapshot", "sql_text", "database_dim"),
    "q16a_process_memory": sql(f"""
SELECT server_id, {idiv('physical_memory_in_use_kb', 1024)} AS in_use_mb,
 {idiv(idiv('physical_memory_in_use_kb', 1024), 1024)} AS in_use_gb, memory_utilization_pct,
 {case(("memory_utilization_pct > 95", "CRITICAL", "over_95_pct"), ("memory_utilization_pct > 80", "ATTENTION", "over_80_pct"))}
FROM process_memory""", "process_memory"),
    "q16b_page_life": sql(f"""
SELECT server_id, cntr_value AS page_life_seconds, {case(("cntr_value < 300", "CRITICAL", "memory_insufficient"),
 ("cntr_value < 1000", "ATTENTION", "watch"))} FROM perf_counter
WHERE counter_name = 'Page life expectancy' AND object_name LIKE '%Buffer Manager%'""", "perf_counter"),
    "q16c_memory_cap": sql(f"""
SELECT m.server_id, {CAP} AS max_memory_mb, {idiv('m.physical_memory_in_use_kb', 1024)} AS in_use_mb,
 {case((f"{CAP} = 2147483647", "CRITICAL", "no_limit"))} FROM process_memory m""", "process_memory", "server_config"),
    "q16d_buffer_by_db": sql(f"""
SELECT b.*, d.name AS database_name, {case(("cached_mb > 10000", "ATTENTION", "large_cache_share"))} FROM (
 SELECT server_id, database_id, {mb('count(*)')} AS cached_mb FROM buffer_page WHERE database_id > 4 GROUP BY ALL) b
{DB.format('b')}""", "buffer_page", "database_dim"),
    "q23a_config_audit": sql(f"""
SELECT server_id, name, configured_value, value_in_use, {case(
 ("name = 'max server memory (MB)' AND value_in_use = 2147483647", "CRITICAL", "no_memory_limit"),
 ("name = 'cost threshold for parallelism' AND value_in_use < 25", "ATTENTION", "threshold_too_low"),
 ("name = 'optimize for ad hoc workloads' AND value_in_use = 0", "ATTENTION", "ad_hoc_off"),
 ("name = 'xp_cmdshell' AND value_in_use = 1", "ATTENTION", "shell_enabled"),
 ("name = 'max degree of parallelism' AND value_in_use = 0", "ATTENTION", "unlimited_parallelism"))}
FROM server_config WHERE name IN ({SETTINGS})""", "server_config"),
    "q23b_database_options": sql(f"""
SELECT server_id, name, recovery_model, is_auto_shrink_on, is_auto_close_on, page_verify, {case(
 ("is_auto_shrink_on = 1", "CRITICAL", "auto_shrink"), ("is_auto_close_on = 1", "CRITICAL", "auto_close"),
 ("page_verify <> 'CHECKSUM'", "ATTENTION", "page_verify"))} FROM database_dim WHERE database_id > 4""", "database_dim"),
    "q13a_qs_capacity": sql(f"""
SELECT *, {case(("actual_state = 'OFF'", "CRITICAL", "query_store_off"), ("actual_state = 'READ_ONLY'", "ATTENTION", "storage_full"),
 ("current_mb > max_mb * 0.8", "ATTENTION", "over_80_pct"))} FROM qs_options""", "qs_options"),
}
