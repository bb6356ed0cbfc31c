from __future__ import annotations

from fleetgauge.oracles.common import EVENTS_NOW, case, idiv, sql

SLICE = (
    "substring(x.text, CAST(r.statement_start_offset // 2 + 1 AS BIGINT), CAST((CASE r.statement_end_offset "
    "WHEN -1 THEN 2 * length(x.text) ELSE r.statement_end_offset END - r.statement_start_offset) // 2 + 1 AS BIGINT))"
)
DB = "LEFT JOIN database_dim d ON d.server_id = {0}.server_id AND d.database_id = {0}.database_id"
IDLE_MINUTES = f"date_diff('minute', last_request_end_time, {EVENTS_NOW})"

ORACLES = {
    "q02_activity_log_latest": sql(
        "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY server_id ORDER BY collection_time DESC, session_id) AS rank FROM session_activity_log) y WHERE rank <= 100",
        "session_activity_log"),
    "q03_active_requests": sql(f"""
SELECT *, {case(("blocking_session_id > 0", "CRITICAL", "blocked"), ("cpu_time > 60000", "ATTENTION", "high_cpu"),
  ("elapsed_seconds > 300", "ATTENTION", "long_running"))} FROM (
 SELECT r.server_id, r.snapshot_ts, row_number() OVER (PARTITION BY r.server_id, r.snapshot_ts
   ORDER BY r.cpu_time DESC, r.session_id, r.request_id) AS rank, r.session_id, r.request_id, r.status, r.cpu_time,
  {idiv('r.total_elapsed_time', 1000)} AS elapsed_seconds, r.logical_reads, r.physical_reads, r.writes, r.wait_type,
  r.blocking_session_id, d.name AS database_name, s.login_name, s.host_name, {SLICE} AS statement
 FROM request_snapshot r JOIN session_snapshot s ON s.server_id = r.server_id AND s.snapshot_ts = r.snapshot_ts
   AND s.session_id = r.session_id
 JOIN sql_text x ON x.sql_handle = r.sql_handle {DB.format('r')}
 WHERE r.session_id > 50 AND s.is_user_process = 1) y WHERE rank <= 20""",
        "request_snapshot", "session_snapshot", "sql_text", "database_dim"),
    "q06_blocking_pairs": sql(f"""
SELECT *, {case(("wait_seconds > 60", "CRITICAL", "blocked_over_60s"), ("wait_seconds > 10", "ATTENTION", "blocked_over_10s"),
  otherwise=("OK", "recent"))} FROM (
 SELECT b.server_id, b.snapshot_ts, g.session_id AS blocking_session_id, substring(gt.text, 1, 300) AS blocker_query,
  b.session_id AS blocked_session_id, substring(bt.text, 1, 300) AS blocked_query, b.wait_type,
  {idiv('b.wait_time', 1000)} AS wait_seconds, d.name AS database_name
 FROM request_snapshot b JOIN request_snapshot g ON g.server_id = b.server_id AND g.snapshot_ts = b.snapshot_ts
  AND b.blocking_session_id = g.session_id
 JOIN sql_text bt ON bt.sql_handle = b.sql_handle JOIN sql_text gt ON gt.sql_handle = g.sql_handle {DB.format('b')}
 WHERE b.blocking_session_id > 0) y""", "request_snapshot", "sql_text", "database_dim"),
    "q07a_session_groups": sql(f"""
SELECT *, {case(("connections > 100", "CRITICAL", "over_100_connections"), ("connections > 50", "ATTENTION", "over_50_connections"),
  ("max_idle_minutes > 60", "ATTENTION", "idle_over_1h"))} FROM (
 SELECT server_id, snapshot_ts, login_name, host_name, program_name, status, count(*) AS connections,
  CAST(sum(CASE WHEN status = 'sleeping' THEN 1 ELSE 0 END) AS BIGINT) AS sleeping,
  CAST(sum(CASE WHEN status = 'running' THEN 1 ELSE 0 END) AS BIGINT) AS running,
  max({IDLE_MINUTES}) AS max_idle_minutes
 FROM session_snapshot WHERE is_user_process = 1 GROUP BY ALL) y""", "session_snapshot"),
    "q07b_idle_sessions": sql(f"""
SELECT *, {case(("idle_minutes > 120", "CRITICAL", "idle_over_2h"), ("idle_minutes > 30", "ATTENTION", "idle_over_30min"))} FROM (
 SELECT server_id, snapshot_ts, session_id, login_name, host_name, program_name, status, last_request_end_time,
  {IDLE_MINUTES} AS idle_minutes
 FROM session_snapshot WHERE is_user_process = 1 AND status = 'sleeping'
  AND last_request_end_time < {EVENTS_NOW} - INTERVAL 30 MINUTE) y""", "session_snapshot"),
    "q07c_connections_per_db": sql(f"""
SELECT c.*, d.name AS database_name, {case(("connections > 200", "CRITICAL", "over_200"), ("connections > 100", "ATTENTION", "over_100"))}
FROM (SELECT r.server_id, r.snapshot_ts, r.database_id, count(*) AS connections
 FROM session_snapshot s LEFT JOIN request_snapshot r ON r.server_id = s.server_id AND r.snapshot_ts = s.snapshot_ts
  AND s.session_id = r.session_id
 WHERE s.is_user_process = 1 AND r.database_id IS NOT NULL GROUP BY ALL) c {DB.format('c')}""",
        "session_snapshot", "request_snapshot", "database_dim"),
    "x02_activity": sql(f"""
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY server_id, snapshot_ts
  ORDER BY elapsed_time DESC NULLS LAST, session_id, request_id) AS rank FROM (
 SELECT s.server_id, s.snapshot_ts, s.session_id, r.request_id, s.status AS session_status, s.login_name, s.host_name,
  s.program_name, d.name AS database_name, r.cpu_time, r.logical_reads AS reads, r.total_elapsed_time AS elapsed_time,
  a.avg_elapsed_time,
  r.wait_type, r.blocking_session_id, coalesce(b.blocked_sessions, 0) AS blocked_sessions, s.open_transaction_count
 FROM session_snapshot s LEFT JOIN request_snapshot r ON r.server_id = s.server_id AND r.snapshot_ts = s.snapshot_ts
  AND r.session_id = s.session_id {DB.format('r')}
 LEFT JOIN (SELECT server_id, snapshot_ts, blocking_session_id, count(*) AS blocked_sessions FROM request_snapshot
   WHERE blocking_session_id > 0 GROUP BY ALL) b ON b.server_id = s.server_id AND b.snapshot_ts = s.snapshot_ts
   AND b.blocking_session_id = s.session_id
 LEFT JOIN (SELECT server_id, snapshot_ts, sql_handle, {idiv('sum(total_elapsed_time)', 'count(*)')} AS avg_elapsed_time
   FROM request_snapshot GROUP BY ALL) a ON a.server_id = r.server_id AND a.snapshot_ts = r.snapshot_ts
   AND a.sql_handle = r.sql_handle
 WHERE s.is_user_process = 1 AND (s.status <> 'sleeping' OR s.open_transaction_count > 0)
  AND d.name = 'DB_7' AND s.program_name <> 'signup') y) z WHERE rank <= 10""",
        "session_snapshot", "request_snapshot", "database_dim"),
}
