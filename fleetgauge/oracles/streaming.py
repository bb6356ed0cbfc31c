from __future__ import annotations

from fleetgauge.functions.waits import IDLE_COLLECTOR
from fleetgauge.oracles.common import big, case, idiv, sql
from fleetgauge.oracles.sessions import DB
from fleetgauge.oracles.waiting import _ranked

NOW = "(SELECT max(ts) FROM events) AS collected_at"
BLOCKED = "blocking_session_id > 0 AND wait_seconds > {0}"
# Events land in four slices of equal length in time, and each slice is collected by itself.
SLICES = 4
ENDS = "(SELECT epoch_us(min(ts)) AS a, epoch_us(max(ts)) - epoch_us(min(ts)) + 1 AS length FROM main.events)"


def by_slice(statement: str) -> str:
    return " UNION ALL ".join(
        "SELECT * FROM (" + statement.replace(
            "WITH ", f"WITH events AS (SELECT v.* FROM main.events v, {ENDS} n WHERE floor((epoch_us(ts) - a) * {SLICES} / length) = {k}), ", 1
        ) + f") s{k}"
        for k in range(SLICES)
    )


COLLECTED = sql(f"""
SELECT 'session' AS log, r.server_id, {NOW}, r.wait_type, r.session_id AS item, r.cpu_time AS measure
FROM request_snapshot r JOIN session_snapshot s ON s.server_id = r.server_id AND s.snapshot_ts = r.snapshot_ts AND s.session_id = r.session_id
JOIN sql_text x ON x.sql_handle = r.sql_handle WHERE s.is_user_process = 1
UNION ALL SELECT 'wait', server_id, {NOW}, wait_type, rank, wait_time_ms FROM {_ranked(IDLE_COLLECTOR, 15)}
UNION ALL SELECT 'block', b.server_id, {NOW}, b.wait_type, b.session_id, {idiv('b.wait_time', 1000)}
FROM request_snapshot b JOIN request_snapshot g ON g.server_id = b.server_id AND g.snapshot_ts = b.snapshot_ts AND b.blocking_session_id = g.session_id
JOIN sql_text bt ON bt.sql_handle = b.sql_handle JOIN sql_text gt ON gt.sql_handle = g.sql_handle WHERE b.blocking_session_id > 0""",
    "request_snapshot", "session_snapshot", "sql_text", "wait_snapshot")
ORACLES = {
    "st1_collect": by_slice(COLLECTED),
    "st2_hourly": sql(f"""
SELECT *, {case(("blocked > 10", "CRITICAL", "over_10_blocked"), ("max_cpu_ms > 300000", "ATTENTION", "cpu_peak"), ("sessions > 100", "ATTENTION", "over_100_sessions"))}
FROM (SELECT server_id, date_trunc('hour', snapshot_ts) AS hour_start, count(DISTINCT session_id) AS sessions,
 max(cpu_time) AS max_cpu_ms, {big('sum(CASE WHEN blocking_session_id > 0 THEN 1 ELSE 0 END)')} AS blocked
 FROM log_session GROUP BY ALL) y
WHERE hour_start + INTERVAL 1 HOUR <= (SELECT max(snapshot_ts) FROM log_session) - INTERVAL 10 MINUTE""", "log_session"),
    "st3_counter_delta": sql("""
SELECT server_id, wait_type, p_ts AS prev_snapshot_ts, snapshot_ts,
 CASE WHEN wait_time_ms >= p_ms THEN wait_time_ms - p_ms ELSE wait_time_ms END AS delta_ms,
 CAST(CASE WHEN wait_time_ms < p_ms THEN 1 ELSE 0 END AS INT) AS was_reset
FROM (SELECT *, lag(snapshot_ts) OVER s AS p_ts, lag(wait_time_ms) OVER s AS p_ms FROM wait_series
 WINDOW s AS (PARTITION BY server_id, wait_type ORDER BY snapshot_ts)) y WHERE p_ts IS NOT NULL""", "wait_series"),
    "st4_alerts": sql(f"""
SELECT * FROM (SELECT a.*, d.name AS database_name, {case(
 (BLOCKED.format(60), "CRITICAL", "blocked_over_60s"), (BLOCKED.format(10), "ATTENTION", "blocked_over_10s"),
 ("cpu_time > 60000", "ATTENTION", "high_cpu"), ("elapsed_seconds > 300", "ATTENTION", "long_running"))}
 FROM (SELECT server_id, snapshot_ts, session_id, blocking_session_id, cpu_time, database_id,
  {idiv('total_elapsed_time', 1000)} AS elapsed_seconds, {idiv('wait_time', 1000)} AS wait_seconds FROM request_snapshot) a {DB.format('a')}) y
WHERE severity <> 'OK'""", "request_snapshot", "database_dim"),
    "st5_late": """
WITH e AS (SELECT user_id % 4 AS batch, ts FROM events),
m AS (SELECT batch, count(*) AS rows, max(ts) AS top FROM e GROUP BY 1),
l AS (SELECT batch, rows, max(top) OVER (ORDER BY batch) AS latest, max(top) OVER (ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS earlier FROM m)
SELECT l.batch, l.rows, l.latest, (SELECT count(*) FROM e WHERE e.batch = l.batch AND e.ts < l.earlier - INTERVAL 1 HOUR) AS late_rows FROM l""",
}

ORACLES["st3b_keyed_delta"] = ORACLES["st3_counter_delta"]
