from __future__ import annotations

from fleetgauge.functions.waits import IDLE_COLLECTOR, IDLE_FULL, IDLE_PLAYBOOK
from fleetgauge.oracles.common import CAPTURES, READINGS, case, exports, pct, sql


def names(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


SHARE = case(("share_pct > 30", "CRITICAL", "dominates"), ("share_pct > 10", "ATTENTION", "relevant"))


def _cause(extended: bool) -> str:
    parallel = "'CXPACKET', 'CXSYNC_PORT'" + (", 'CXSYNC_CONSUMER'" if extended else "")
    backup = "WHEN wait_type = 'BACKUPIO' THEN 'backup_running'" if extended else ""
    return f"""CASE WHEN wait_type IN ('PAGEIOLATCH_SH', 'PAGEIOLATCH_EX') THEN 'slow_disk_or_missing_index'
  WHEN wait_type IN ({parallel}) THEN 'parallelism' WHEN wait_type = 'SOS_SCHEDULER_YIELD' THEN 'cpu_pressure'
  WHEN wait_type = 'WRITELOG' THEN 'slow_log' WHEN wait_type = 'RESOURCE_SEMAPHORE' THEN 'memory_shortage'
  WHEN wait_type LIKE 'LCK_M_%' THEN 'blocking' WHEN wait_type = 'ASYNC_NETWORK_IO' THEN 'slow_client' {backup}
  ELSE 'look_up' END"""


def _ranked(exclude, top: int) -> str:
    return f"""(SELECT *, row_number() OVER (PARTITION BY server_id ORDER BY wait_time_ms DESC, wait_type) AS rank,
  {pct('wait_time_ms', 'total_ms')} AS share_pct, {pct('signal_wait_time_ms', 'wait_time_ms')} AS signal_pct
  FROM (SELECT *, sum(wait_time_ms) OVER (PARTITION BY server_id) AS total_ms FROM wait_snapshot
    WHERE wait_type NOT IN ({names(exclude)})) w QUALIFY rank <= {top}) y"""


DELTA = f"""SELECT *, {case(("delta_wait_ms > 60000", "CRITICAL", "over_1min"), ("delta_wait_ms > 10000", "ATTENTION", "relevant"))} FROM (
 SELECT a.server_id, a.wait_type, n.wait_time_ms - a.wait_time_ms AS delta_wait_ms,
  n.waiting_tasks_count - a.waiting_tasks_count AS delta_tasks
 FROM wait_snapshot_earlier a JOIN wait_snapshot n ON n.server_id = a.server_id AND n.wait_type = a.wait_type
 WHERE a.wait_type NOT LIKE 'SLEEP%' AND a.wait_type NOT LIKE '%IDLE%' AND a.wait_type NOT LIKE '%QUEUE%'
  AND n.wait_time_ms > a.wait_time_ms) y"""

WAITS = ("wait_time_ms", "waiting_tasks_count")
DELTA_EXPORTS = f"""SELECT *, {case(("delta_wait_ms > 60000", "CRITICAL", "over_1min"), ("delta_wait_ms > 10000", "ATTENTION", "relevant"))} FROM (
 SELECT server_id, snapshot_ts, wait_type, wait_time_ms - before_ms AS delta_wait_ms, waiting_tasks_count - before_tasks AS delta_tasks FROM (
  SELECT n.server_id, n.snapshot_ts, n.wait_type, n.wait_time_ms, n.waiting_tasks_count, a.wait_time_ms AS before_ms, a.waiting_tasks_count AS before_tasks
  FROM {exports("wait_snapshot_earlier", WAITS, CAPTURES)} a
  JOIN {exports("wait_snapshot", WAITS, READINGS)} n ON n.server_id = a.server_id AND n.wait_type = a.wait_type AND a.snapshot_ts <= n.snapshot_ts
  WHERE a.wait_type NOT LIKE 'SLEEP%' AND a.wait_type NOT LIKE '%IDLE%' AND a.wait_type NOT LIKE '%QUEUE%'
  QUALIFY row_number() OVER (PARTITION BY n.server_id, n.wait_type, n.snapshot_ts ORDER BY a.snapshot_ts DESC) = 1) m
 WHERE wait_time_ms > before_ms) y"""

ORACLES = {
    "q04c_wait_capture": sql("""
SELECT server_id, wait_type, waiting_tasks_count, wait_time_ms, signal_wait_time_ms FROM wait_snapshot_earlier
WHERE wait_type NOT LIKE 'SLEEP%' AND wait_type NOT LIKE '%IDLE%' AND wait_type NOT LIKE '%QUEUE%'""",
        "wait_snapshot_earlier"),
    "q04d_wait_delta": sql(DELTA, "wait_snapshot_earlier", "wait_snapshot"),
    "q04e_wait_delta_exports": sql(DELTA_EXPORTS, "wait_snapshot_earlier", "wait_snapshot"),
    "q05_wait_ranking": sql(f"""
SELECT server_id, wait_type, waiting_tasks_count, wait_time_ms, signal_wait_time_ms, max_wait_time_ms, rank,
 share_pct, signal_pct, {_cause(True)} AS cause, {SHARE} FROM {_ranked(IDLE_FULL, 20)}""", "wait_snapshot"),
    "q26b_collect_waits": sql(f"""
SELECT server_id, TIMESTAMP '2024-01-31 00:00:00' AS collected_at, rank, wait_type, waiting_tasks_count, wait_time_ms,
 signal_wait_time_ms, share_pct FROM {_ranked(IDLE_COLLECTOR, 15)}""", "wait_snapshot"),
    "q29b_wait_actions": sql(f"""
SELECT server_id, wait_type, waiting_tasks_count, wait_time_ms, signal_wait_time_ms, rank,
 share_pct, signal_pct, {_cause(False)} AS action, {SHARE} FROM {_ranked(IDLE_PLAYBOOK, 10)}""", "wait_snapshot"),
    "x04_two_sample_delta": sql("""
SELECT server_id, wait_type, p_ts AS prev_snapshot_ts, snapshot_ts,
 CASE WHEN wait_time_ms >= p_ms THEN wait_time_ms - p_ms ELSE wait_time_ms END AS delta_ms,
 date_diff('second', p_ts, snapshot_ts) AS seconds, CASE WHEN wait_time_ms < p_ms THEN 1 ELSE 0 END AS was_reset,
 (CASE WHEN wait_time_ms >= p_ms THEN wait_time_ms - p_ms ELSE wait_time_ms END) / date_diff('second', p_ts, snapshot_ts)
  AS ms_per_second
FROM (SELECT *, lag(snapshot_ts) OVER s AS p_ts, lag(wait_time_ms) OVER s AS p_ms FROM wait_series
 WINDOW s AS (PARTITION BY server_id, wait_type ORDER BY snapshot_ts)) y WHERE p_ts IS NOT NULL""", "wait_series"),
    "x04b_delta_since_startup": sql("""
SELECT server_id, wait_type, max(snapshot_ts) AS snapshot_ts, arg_max(wait_time_ms, snapshot_ts) AS delta_ms,
 CAST(0 AS INT) AS was_reset FROM wait_series GROUP BY ALL""", "wait_series"),
    "x19_wait_playbook": sql(f"""
SELECT server_id, wait_type, wait_time_ms, share_pct, CASE WHEN wait_type LIKE 'PAGEIOLATCH%' THEN 'missing_indexes,fragmentation'
 WHEN wait_type = 'CXPACKET' THEN 'raise_cost_threshold' WHEN wait_type LIKE 'SOS_SCHEDULER%' THEN 'heavy_queries'
 WHEN wait_type = 'WRITELOG' THEN 'file_latency' WHEN wait_type = 'RESOURCE_SEMAPHORE' THEN 'memory_grants,server_memory'
 WHEN wait_type LIKE 'LCK_M_%' THEN 'blocking' WHEN wait_type LIKE 'ASYNC_NETWORK%' THEN 'client_application'
 ELSE 'look_up' END AS next_report FROM {_ranked(IDLE_PLAYBOOK, 1)}""", "wait_snapshot"),
}
