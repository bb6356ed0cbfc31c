from __future__ import annotations

from fleetgauge.oracles.common import EVENTS_NOW, big, case, idiv, pct, rdiv, sql
from fleetgauge.oracles.sessions import DB, SLICE


def _cpu(critical: int, attention: int, *more) -> str:
    return case((f"avg_cpu_us > {critical}", "CRITICAL", "avg_cpu_critical"),
                (f"avg_cpu_us > {attention}", "ATTENTION", "avg_cpu_high"), *more)


def _procs(*more) -> str:
    return sql(f"""
SELECT *, {_cpu(1000000, 100000, *more)} FROM (SELECT p.server_id, p.object_id, p.proc_name, d.name AS database_name,
 p.execution_count, {idiv('p.total_worker_time', 'p.execution_count')} AS avg_cpu_us, p.total_worker_time AS total_cpu_us,
 {idiv('p.total_elapsed_time', 'p.execution_count')} AS avg_duration_us,
 {idiv('p.total_logical_reads', 'p.execution_count')} AS avg_reads, p.last_execution_time,
 row_number() OVER (PARTITION BY p.server_id ORDER BY p.total_worker_time DESC, p.object_id) AS rank
 FROM proc_stats p {DB.format('p')} WHERE p.proc_name IS NOT NULL) y WHERE rank <= 20""", "proc_stats", "database_dim")


def _cache(order: str, column: str) -> str:
    return f"""SELECT '{order}' AS sort_order, server_id, query_hash, execution_count, total_worker_time, total_logical_reads,
 total_elapsed_time, max_grant_kb, row_number() OVER (PARTITION BY server_id ORDER BY {column} DESC, query_hash) AS rank
 FROM query_stats QUALIFY rank <= 10"""


QS = """qs_query q JOIN qs_text x ON x.server_id = q.server_id AND x.query_text_id = q.query_text_id
 JOIN qs_plan p ON p.server_id = q.server_id AND p.query_id = q.query_id
 JOIN qs_runtime r ON r.server_id = p.server_id AND r.plan_id = p.plan_id
 JOIN qs_interval i ON i.server_id = r.server_id AND i.interval_id = r.interval_id"""
QS_TABLES = ("qs_query", "qs_text", "qs_plan", "qs_runtime", "qs_interval")
GROUPED = f"""q.server_id, q.query_id, x.query_sql_text, {big('sum(r.count_executions)')} AS executions,
  {rdiv('sum(r.avg_duration)', 'count(*) * 1000', 2)} AS avg_duration_ms, {rdiv('sum(r.avg_cpu_time)', 'count(*) * 1000', 2)} AS avg_cpu_ms,
  {idiv('sum(r.avg_logical_io_reads)', 'count(*)')} AS avg_reads, count(DISTINCT p.plan_id) AS plan_count,
  max(r.last_execution_time) AS last_execution, avg(r.avg_duration) AS mean_us, avg(r.avg_logical_io_reads) AS mean_reads"""


def _duration(hours: int, extra: str, ladder: str) -> str:
    return sql(f"""
SELECT server_id, rank, query_id, query_sql_text, executions, avg_duration_ms, avg_cpu_ms, {extra} last_execution, {ladder}
FROM (SELECT *, row_number() OVER (PARTITION BY server_id ORDER BY mean_us DESC, query_id) AS rank FROM (
 SELECT {GROUPED} FROM {QS} WHERE i.start_time >= {EVENTS_NOW} - INTERVAL {hours} HOUR
 GROUP BY q.server_id, q.query_id, x.query_sql_text) g) y WHERE rank <= 20""", *QS_TABLES)


PERIOD = """SELECT p.server_id, p.query_id, avg(r.avg_duration) AS mean_us, avg(r.avg_logical_io_reads) AS mean_reads,
 sum(r.avg_duration) AS duration, sum(r.avg_cpu_time) AS cpu, sum(r.avg_logical_io_reads) AS reads, count(*) AS n,
 sum(r.count_executions) AS executions, max(r.last_execution_time) AS last_execution, count(DISTINCT p.plan_id) AS plan_count
 FROM qs_plan p JOIN qs_runtime r ON r.server_id = p.server_id AND r.plan_id = p.plan_id
 JOIN qs_interval i ON i.server_id = r.server_id AND i.interval_id = r.interval_id WHERE {0} GROUP BY ALL"""


def regressions(recent: str, history: str) -> str:
    now = EVENTS_NOW
    return sql(f"""
WITH re AS ({PERIOD.format(f"i.start_time >= {now} - INTERVAL {recent}")}),
hi AS ({PERIOD.format(f"i.start_time BETWEEN {now} - INTERVAL {history} AND {now} - INTERVAL {recent}")})
SELECT re.server_id, row_number() OVER (PARTITION BY re.server_id ORDER BY
  {rdiv('re.duration * hi.n', 'hi.duration * re.n', 2)} DESC, re.query_id) AS rank, re.query_id, x.query_sql_text,
 {rdiv('re.duration', 're.n * 1000', 2)} AS recent_ms, {rdiv('hi.duration', 'hi.n * 1000', 2)} AS history_ms,
 {rdiv('re.cpu', 're.n * 1000', 2)} AS recent_cpu_ms, {rdiv('re.reads', 're.n', 0)} AS recent_reads,
 {rdiv('hi.reads', 'hi.n', 0)} AS history_reads, {rdiv('re.duration * hi.n', 'hi.duration * re.n', 2)} AS factor,
 {big('re.executions')} AS recent_executions, {big('hi.executions')} AS history_executions, re.plan_count, re.last_execution,
 {case(("re.mean_us > hi.mean_us * 5", "CRITICAL", "slower_5x"), ("re.mean_us > hi.mean_us * 2", "ATTENTION", "slower_2x"),
  ("re.plan_count > 3", "ATTENTION", "many_plans"), ("re.mean_reads > hi.mean_reads * 3", "ATTENTION", "reads_tripled"))}
FROM re JOIN hi ON hi.server_id = re.server_id AND hi.query_id = re.query_id
JOIN qs_query q ON q.server_id = re.server_id AND q.query_id = re.query_id
JOIN qs_text x ON x.server_id = q.server_id AND x.query_text_id = q.query_text_id
WHERE re.mean_us > hi.mean_us * 1.5 QUALIFY rank <= 20""", *QS_TABLES)


FACTOR = rdiv("r.avg_duration", "h.avg_duration", 2)
ORACLES = {
    "q04a_query_cpu": sql(f"""
SELECT *, {_cpu(1000000, 100000)} FROM (
 SELECT r.server_id, row_number() OVER (PARTITION BY r.server_id ORDER BY r.total_worker_time DESC, r.query_hash) AS rank,
  r.query_hash, {idiv('r.total_worker_time', 'r.execution_count')} AS avg_cpu_us, r.total_worker_time AS total_cpu_us,
  r.execution_count, {idiv('r.total_elapsed_time', 'r.execution_count')} AS avg_elapsed_us,
  {idiv('r.total_logical_reads', 'r.execution_count')} AS avg_reads, r.last_execution_time, d.name AS database_name,
  {SLICE} AS statement
 FROM query_stats r JOIN sql_text x ON x.sql_handle = r.sql_handle {DB.format('r')}) y WHERE rank <= 20""",
        "query_stats", "sql_text", "database_dim"),
    "q04b_proc_cpu": _procs(),
    "q11_proc_ranking": _procs(("avg_reads > 100000", "ATTENTION", "avg_reads_high")),
    "q12a_trigger_cpu": sql(f"""
SELECT *, {_cpu(500000, 100000)} FROM (
 SELECT s.server_id, row_number() OVER (PARTITION BY s.server_id ORDER BY s.total_worker_time DESC, s.object_id) AS rank,
  g.name AS trigger_name, g.parent_name AS parent_table, d.name AS database_name,
  {idiv('s.total_worker_time', 's.execution_count')} AS avg_cpu_us, s.total_worker_time AS total_cpu_us, s.execution_count,
  {idiv('s.total_elapsed_time', 's.execution_count')} AS avg_duration_us, s.last_execution_time
 FROM trigger_stats s JOIN trigger_dim g ON g.server_id = s.server_id AND g.database_id = s.database_id
  AND g.object_id = s.object_id {DB.format('s')}) y WHERE rank <= 20""", "trigger_stats", "trigger_dim", "database_dim"),
    "q12b_trigger_inventory": sql(f"""
SELECT server_id, database_id, name AS trigger_name, parent_name AS parent_table, is_disabled,
 {case(("is_disabled = 1", "ATTENTION", "disabled"))} FROM trigger_dim WHERE parent_class = 'OBJECT_OR_COLUMN'""", "trigger_dim"),
    "q19a_cached_plans": sql(f"""
SELECT *, {case(("usecounts = 1", "ATTENTION", "single_use"), ("usecounts > 100000", "ATTENTION", "high_volume"))} FROM (
 SELECT c.server_id, row_number() OVER (PARTITION BY c.server_id ORDER BY c.usecounts DESC, c.plan_handle) AS rank,
  c.plan_handle, c.usecounts, {idiv('c.size_in_bytes', 1024)} AS size_kb, c.objtype, d.name AS database_name,
  substring(x.text, 1, 200) AS query
 FROM cached_plan c JOIN sql_text x ON x.sql_handle = c.sql_handle {DB.format('c')}
 WHERE c.objtype IN ('Adhoc', 'Prepared', 'Proc') AND c.database_id IS NOT NULL) y WHERE rank <= 50""",
        "cached_plan", "sql_text", "database_dim"),
    "q19b_single_use_ratio": sql(f"""
SELECT *, {case(("single_use_pct > 40", "CRITICAL", "enable_ad_hoc_optimisation"), ("single_use_pct > 20", "ATTENTION", "many_single_use_plans"))}
FROM (SELECT server_id, objtype, count(*) AS plans, {big('sum(CASE WHEN usecounts = 1 THEN 1 ELSE 0 END)')} AS single_use,
 {idiv(idiv('sum(size_in_bytes)', 1024), 1024)} AS total_mb,
 {pct('sum(CASE WHEN usecounts = 1 THEN 1 ELSE 0 END)', 'count(*)', 1)} AS single_use_pct
 FROM cached_plan WHERE objtype IN ('Adhoc', 'Prepared', 'Proc') GROUP BY ALL) y""", "cached_plan"),
    "x05_cache_topk": sql(" UNION ALL ".join(_cache(o, c) for o, c in (
        ("cpu", "total_worker_time"), ("reads", "total_logical_reads"), ("duration", "total_elapsed_time"),
        ("memory grant", "max_grant_kb"), ("executions", "execution_count"))), "query_stats"),
    "q13b_qs_top_duration": _duration(24, "avg_reads, plan_count,", case(
        ("plan_count > 3", "CRITICAL", "many_plans"), ("mean_us / 1000.0 > 5000", "CRITICAL", "over_5s"),
        ("mean_us / 1000.0 > 1000", "ATTENTION", "over_1s"))),
    "q29c_qs_recent": _duration(4, "", case(
        ("mean_us / 1000.0 > 5000", "CRITICAL", "over_5s"), ("mean_us / 1000.0 > 1000", "ATTENTION", "over_1s"))),
    "q28h_qs_reads_impact": sql(f"""
SELECT server_id, rank, query_id, query_sql_text, executions, avg_duration_ms, avg_cpu_ms, avg_reads, plan_count,
 {case(("plan_count > 3", "CRITICAL", "many_plans"), ("mean_reads < 1000", "OK", "low_reads"),
  ("mean_reads < 10000", "ATTENTION", "moderate_reads"), otherwise=("CRITICAL", "very_high_reads"))}
FROM (SELECT *, row_number() OVER (PARTITION BY server_id ORDER BY mean_reads DESC, query_id) AS rank FROM (
 SELECT {GROUPED} FROM {QS} WHERE i.start_time >= {EVENTS_NOW} - INTERVAL 7 DAY
  AND (x.query_sql_text ILIKE '%t1%' OR x.query_sql_text ILIKE '%t2%' OR x.query_sql_text ILIKE '%t3%' OR x.query_sql_text ILIKE '%t4%')
 GROUP BY q.server_id, q.query_id, x.query_sql_text) g) y WHERE rank <= 20""", *QS_TABLES),
    "q34a_regressions": regressions("24 HOUR", "30 DAY"),
    "q34a_regressions_1h": regressions("1 HOUR", "24 HOUR"),
    "q13c_plan_regression_pairs": sql(f"""
SELECT server_id, rank, query_id, query_sql_text, plan_id, recent_id, history_id, {rdiv('r_us', '1000', 2)} AS recent_ms,
 {rdiv('h_us', '1000', 2)} AS history_ms, factor, last_execution,
 {case(("r_us > h_us * 5", "CRITICAL", "slower_5x"), ("r_us > h_us * 2", "ATTENTION", "slower_2x"))} FROM (
 SELECT q.server_id, q.query_id, x.query_sql_text, p.plan_id, r.runtime_id AS recent_id, h.runtime_id AS history_id,
  r.avg_duration AS r_us, h.avg_duration AS h_us, {FACTOR} AS factor, r.last_execution_time AS last_execution,
  row_number() OVER (PARTITION BY q.server_id ORDER BY {FACTOR} DESC NULLS LAST, r.avg_duration DESC, r.runtime_id,
   h.avg_duration, h.runtime_id) AS rank
 FROM qs_query q JOIN qs_text x ON x.server_id = q.server_id AND x.query_text_id = q.query_text_id
 JOIN qs_plan p ON p.server_id = q.server_id AND p.query_id = q.query_id
 JOIN qs_runtime r ON r.server_id = p.server_id AND r.plan_id = p.plan_id
 JOIN qs_interval ri ON ri.server_id = r.server_id AND ri.interval_id = r.interval_id
  AND ri.start_time >= {EVENTS_NOW} - INTERVAL 24 HOUR
 JOIN qs_runtime h ON h.server_id = p.server_id AND h.plan_id = p.plan_id
 JOIN qs_interval hi ON hi.server_id = h.server_id AND hi.interval_id = h.interval_id
  AND hi.start_time BETWEEN {EVENTS_NOW} - INTERVAL 30 DAY AND {EVENTS_NOW} - INTERVAL 24 HOUR
 WHERE r.avg_duration > h.avg_duration * 2) y WHERE rank <= 20""", *QS_TABLES),
    "q34b_plan_list": sql("""
SELECT *, row_number() OVER (PARTITION BY server_id, query_id ORDER BY first_execution_time, plan_id) AS plan_order FROM qs_plan""",
        "qs_plan"),
}
