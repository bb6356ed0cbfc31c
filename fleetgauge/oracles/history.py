from __future__ import annotations

from fleetgauge.oracles.common import EVENTS_NOW, ORDERS_NOW, big, case, days, hours, idiv, pct, rdiv, sql
from fleetgauge.oracles.sessions import SLICE

GB = 1024**3
MAINTENANCE = sql(f"""
SELECT * FROM (SELECT *, {case(("error_number IS NOT NULL", "CRITICAL", "error"), ("seconds > 3600", "ATTENTION", "over_1h"))} FROM (
 SELECT server_id, command_id, database_name, table_name, index_name, command_type, start_time, end_time,
  date_diff('second', start_time, end_time) AS seconds, CAST(error_number AS DOUBLE) AS error_number, error_message,
  row_number() OVER (PARTITION BY server_id ORDER BY start_time DESC, command_id) AS rank
 FROM command_log) y) z WHERE rank <= 100""", "command_log")
FULL = f"type = 'D' AND backup_finish_date >= {ORDERS_NOW} - INTERVAL 6 MONTH"
RUN_AT = "strptime(CAST(run_date AS VARCHAR) || lpad(CAST(run_time AS VARCHAR), 6, '0'), '%Y%m%d%H%M%S')"
DAY = f"date_diff('day', CAST({ORDERS_NOW} AS DATE), CAST(backup_finish_date AS DATE))"
COLLECTED = f"{EVENTS_NOW} AS collected_at"

ORACLES = {
    "q09b_maintenance_log": MAINTENANCE,
    "q27_maintenance_log": MAINTENANCE,
    "q20a_backup_age": sql(f"""
SELECT *, {case(("last_full IS NULL", "CRITICAL", "never_full"), ("hours_since_full > 48", "CRITICAL", "full_over_48h"),
  ("hours_since_full > 24", "ATTENTION", "full_over_24h"))} FROM (
 SELECT *, CAST({hours('last_full', ORDERS_NOW)} AS DOUBLE) AS hours_since_full FROM (
  SELECT server_id, database_name, max(CASE WHEN type = 'D' THEN backup_finish_date END) AS last_full,
   max(CASE WHEN type = 'I' THEN backup_finish_date END) AS last_differential,
   max(CASE WHEN type = 'L' THEN backup_finish_date END) AS last_log FROM backupset GROUP BY ALL) g) y""", "backupset"),
    "q21_integrity_age": sql(f"""
SELECT *, {case(("last_check IS NULL", "CRITICAL", "never_checked"), ("days_since_check > 30", "CRITICAL", "over_30d"),
  ("days_since_check > 7", "ATTENTION", "over_7d"))} FROM (
 SELECT server_id, name, last_good_check_time AS last_check, CAST({days('last_good_check_time', EVENTS_NOW)} AS DOUBLE) AS days_since_check
 FROM database_dim WHERE state_desc = 'ONLINE' AND database_id > 4) y""", "database_dim"),
    "q22_job_failures": sql(f"""
SELECT h.server_id, h.instance_id, j.name AS job, h.step_name, {RUN_AT} AS executed_at,
 CASE h.run_status WHEN 0 THEN 'FAILED' WHEN 1 THEN 'OK' WHEN 2 THEN 'RETRY' WHEN 3 THEN 'CANCELLED' END AS result,
 left(h.message, 500) AS message, {case(("h.run_status = 0", "CRITICAL", "job_failed"), ("h.run_status = 2", "ATTENTION", "job_retried"),
  ("h.run_status = 3", "ATTENTION", "job_cancelled"))}
FROM job_dim j JOIN job_history h ON h.server_id = j.server_id AND h.job_id = j.job_id
WHERE h.run_status IN (0, 2, 3) AND {RUN_AT} >= {EVENTS_NOW} - INTERVAL 24 HOUR""", "job_dim", "job_history"),
    "q31a_backup_growth": sql(f"""
SELECT server_id, database_name, backup_set_id, backup_finish_date, {rdiv('backup_size', str(GB), 2)} AS backup_gb,
 {rdiv('compressed_backup_size', str(GB), 2)} AS compressed_gb, {pct('backup_size - compressed_backup_size', 'backup_size', 1)} AS compression_pct,
 {rdiv('growth', str(GB), 2)} AS growth_gb, {case((f"growth > {10 * GB}", "CRITICAL", "grew_over_10gb"), (f"growth > {5 * GB}", "ATTENTION", "grew_over_5gb"))}
FROM (SELECT *, backup_size - lag(backup_size) OVER (PARTITION BY server_id, database_name ORDER BY backup_finish_date, backup_set_id) AS growth
 FROM backupset WHERE {FULL}) y""", "backupset"),
    "q31b_monthly_size": sql(f"""
SELECT server_id, database_name, year, month, {rdiv('max_bytes', str(GB), 2)} AS max_gb, backups, {rdiv('max_bytes - min_bytes', str(GB), 2)} AS spread_gb,
 {case((f"max_bytes - min_bytes > {10 * GB}", "CRITICAL", "varied_over_10gb"), (f"max_bytes - min_bytes > {5 * GB}", "ATTENTION", "varied_over_5gb"))}
FROM (SELECT server_id, database_name, CAST(year(backup_finish_date) AS INT) AS year, CAST(month(backup_finish_date) AS INT) AS month,
 max(backup_size) AS max_bytes, min(backup_size) AS min_bytes, count(*) AS backups FROM backupset WHERE {FULL} GROUP BY ALL) y""", "backupset"),
    "q32b_restart_events": sql("""
SELECT log_id, log_type, CAST(n - 1 AS INT) AS line_number, phrase, line FROM (
 SELECT log_id, log_type, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM error_log) l
JOIN (VALUES ('license'), ('and the')) p(phrase) ON contains(lower(line), phrase)""", "error_log"),
    "q26a_collect_sessions": sql(f"""
SELECT r.server_id, r.snapshot_ts, {COLLECTED}, r.session_id, r.status, r.blocking_session_id, r.cpu_time,
 {idiv('r.total_elapsed_time', 1000)} AS elapsed_seconds, r.logical_reads, r.writes, r.wait_type, {idiv('r.wait_time', 1000)} AS wait_seconds,
 d.name AS database_name, s.login_name, {SLICE} AS statement
FROM request_snapshot r JOIN session_snapshot s ON s.server_id = r.server_id AND s.snapshot_ts = r.snapshot_ts AND s.session_id = r.session_id
JOIN sql_text x ON x.sql_handle = r.sql_handle
LEFT JOIN database_dim d ON d.server_id = r.server_id AND d.database_id = r.database_id
WHERE s.is_user_process = 1 AND r.session_id <> 51""", "request_snapshot", "session_snapshot", "sql_text", "database_dim"),
    "q26c_collect_blocks": sql(f"""
SELECT b.server_id, b.snapshot_ts, {COLLECTED}, g.session_id AS blocking_session_id, b.session_id AS blocked_session_id, b.wait_type,
 {idiv('b.wait_time', 1000)} AS wait_seconds, gt.text AS blocker_query, bt.text AS blocked_query
FROM request_snapshot b JOIN request_snapshot g ON g.server_id = b.server_id AND g.snapshot_ts = b.snapshot_ts AND b.blocking_session_id = g.session_id
JOIN sql_text bt ON bt.sql_handle = b.sql_handle JOIN sql_text gt ON gt.sql_handle = g.sql_handle
WHERE b.blocking_session_id > 0""", "request_snapshot", "sql_text"),
    "q26d_hourly_history": sql(f"""
SELECT *, {case(("blocked > 10", "CRITICAL", "over_10_blocked"), ("max_cpu_ms > 300000", "ATTENTION", "cpu_peak"), ("sessions > 100", "ATTENTION", "over_100_sessions"))}
FROM (SELECT server_id, date_trunc('day', snapshot_ts) AS day, CAST(hour(snapshot_ts) AS INT) AS hour, count(DISTINCT session_id) AS sessions,
 max(cpu_time) AS max_cpu_ms, {big('sum(CASE WHEN blocking_session_id > 0 THEN 1 ELSE 0 END)')} AS blocked
 FROM log_session WHERE snapshot_ts >= {EVENTS_NOW} - INTERVAL 24 HOUR GROUP BY ALL) y""", "log_session"),
    "x21_growth_forecast": sql(f"""
SELECT server_id, database_name, backups, mb_per_day, mean_mb,
 CASE WHEN mb_per_day > 0 THEN greatest(CAST(ceil((500000 - (CAST(sy AS DOUBLE) - mb_per_day * CAST(sx AS DOUBLE)) / backups) / mb_per_day) AS DOUBLE), 0) END AS days_to_capacity
FROM (SELECT sx, sy, server_id, database_name, n AS backups, CAST(n * sxy - sx * sy AS DOUBLE) / CAST(nullif(n * sxx - sx * sx, 0) AS DOUBLE) AS mb_per_day,
 CAST(sy AS DOUBLE) / n AS mean_mb FROM (
 SELECT server_id, database_name, count(*) AS n, sum(CAST(x AS HUGEINT)) AS sx, sum(CAST(y AS HUGEINT)) AS sy, sum(CAST(x AS HUGEINT) * y) AS sxy,
  sum(CAST(x AS HUGEINT) * x) AS sxx
 FROM (SELECT server_id, database_name, {DAY} AS x, {idiv('backup_size', 1024**2)} AS y FROM backupset WHERE type = 'D' AND backup_finish_date <= {ORDERS_NOW}) b GROUP BY ALL) s) y""", "backupset"),
    "x21b_growth_after_shifts": sql(f"""
WITH b AS (SELECT server_id, database_name, backup_finish_date, backup_set_id, {DAY} AS x, {idiv('backup_size', 1024**2)} AS y
 FROM backupset WHERE type = 'D' AND backup_finish_date <= {ORDERS_NOW}),
s AS (SELECT *, y - lag(y) OVER o AS step FROM b WINDOW o AS (PARTITION BY server_id, database_name ORDER BY backup_finish_date, backup_set_id)),
u AS (SELECT server_id, database_name, quantile_disc(abs(step), 0.5) AS usual FROM s GROUP BY ALL),
p AS (SELECT s.*, sum(CASE WHEN abs(step) > usual * 8 AND abs(step) * 10 > abs(y - step) THEN 1 ELSE 0 END)
 OVER (PARTITION BY server_id, database_name ORDER BY backup_finish_date, backup_set_id ROWS UNBOUNDED PRECEDING) AS part FROM s JOIN u USING (server_id, database_name)),
l AS (SELECT *, max(part) OVER (PARTITION BY server_id, database_name) AS shifts FROM p QUALIFY part = shifts),
q AS (SELECT server_id, database_name, shifts, x, y, row_number() OVER (PARTITION BY server_id, database_name ORDER BY backup_finish_date, backup_set_id) - 1 AS i,
 count(*) OVER (PARTITION BY server_id, database_name) AS n FROM l),
a AS (SELECT *, (i + CASE WHEN n - 1 <= 16 THEN j ELSE (i * 7919 + j * 104729) % (n - 1) + 1 END) % n AS other
 FROM (SELECT *, unnest(range(1, least(n - 1, 16) + 1)) AS j FROM q WHERE n > 1) e),
m AS (SELECT a.server_id, a.database_name, quantile_disc((r.y - a.y) / CAST(r.x - a.x AS DOUBLE), 0.5) AS mb_per_day
 FROM a JOIN q r ON r.server_id = a.server_id AND r.database_name = a.database_name AND r.i = a.other WHERE r.x <> a.x GROUP BY ALL)
SELECT *, CASE WHEN mb_per_day > 0 THEN greatest(CAST(ceil((500000 - mb_now) / mb_per_day) AS DOUBLE), 0) END AS days_to_capacity FROM (
 SELECT q.server_id, q.database_name, CAST(max(shifts) AS BIGINT) AS level_shifts, count(*) AS backups, any_value(mb_per_day) AS mb_per_day,
  quantile_disc(y - coalesce(mb_per_day, 0) * x, 0.5) AS mb_now
 FROM q LEFT JOIN m ON m.server_id = q.server_id AND m.database_name = q.database_name GROUP BY q.server_id, q.database_name) y""", "backupset"),
}
