"""Telemetry derived from the star-schema tables, for tests and the bench.

The values are arithmetic on whole tables: every projection reads all rows of its
table, and the number of servers, databases, queries and texts grows with the input.
The statements keep to syntax that Spark SQL and an ANSI engine share, because the
correctness check inlines them as common table expressions.
"""

from __future__ import annotations

import re


def _per(expr: str, n: int) -> str:
    return f"CAST(FLOOR(({expr}) / {n}) AS BIGINT)"


_CENTS = "CAST(ROUND(value * 100) AS BIGINT)"
_PRICE = "CAST(ROUND(l_extendedprice) AS BIGINT)"
_QTY = "CAST(l_quantity AS BIGINT)"
_EVENT_SERVER = _per("event_id", 100)
_USER_SERVER = "CAST(FLOOR(user_id * 2 / 3) AS BIGINT)"
_STORE_SERVER = _per("user_id", 50)
_PART_SERVER = _per("p_partkey", 20)
_LINE_SERVER = _per("l_partkey", 20)
_SNAPSHOT = (
    f"CASE {_per('event_id % 100', 25)} WHEN 0 THEN TIMESTAMP '2024-01-30 18:00:00' "
    "WHEN 1 THEN TIMESTAMP '2024-01-30 20:00:00' WHEN 2 THEN TIMESTAMP '2024-01-30 22:00:00' "
    "ELSE TIMESTAMP '2024-01-30 23:30:00' END"
)
_BLOCKER = (
    "CASE WHEN event_id % 5 IN (1, 2, 3) THEN 50 + event_id "
    "WHEN event_id % 35 = 0 THEN 54 + event_id ELSE 0 END"
)
_WAIT_NAMES = (
    "PAGEIOLATCH_SH,CXPACKET,SOS_SCHEDULER_YIELD,WRITELOG,RESOURCE_SEMAPHORE,LCK_M_X,"
    "ASYNC_NETWORK_IO,BACKUPIO,SLEEP_TASK,PAGEIOLATCH_EX,CXSYNC_PORT,CXSYNC_CONSUMER,LCK_M_S,"
    "LCK_M_U,LATCH_EX,THREADPOOL,IO_COMPLETION,PAGELATCH_EX,PAGELATCH_SH,CMEMTHREAD,OLEDB,"
    "LOGBUFFER,PREEMPTIVE_OS_WRITEFILE,LAZYWRITER_SLEEP,XE_TIMER_EVENT,"
    "DISPATCHER_QUEUE_SEMAPHORE,SERVER_IDLE_CHECK,CHECKPOINT_QUEUE,BROKER_TO_FLUSH"
)
_WAIT = f"split_part('{_WAIT_NAMES}', ',', CAST(event_id % 29 + 1 AS INT))"
_WAIT_MS = f"{_CENTS} * (CASE event_id % 29 WHEN 0 THEN 30 WHEN 1 THEN 10 WHEN 5 THEN 8 ELSE 2 END)"
_SETTING_NAMES = (
    "max server memory (MB),min server memory (MB),max degree of parallelism,"
    "cost threshold for parallelism,optimize for ad hoc workloads,xp_cmdshell,"
    "backup compression default,remote admin connections,fill factor (%),locks,"
    "nested triggers,priority boost,query wait (s),recovery interval (min),remote access,"
    "scan for startup procs,show advanced options,two digit year cutoff,user connections,user options"
)
_SETTING = f"split_part('{_SETTING_NAMES}', ',', CAST(p_partkey % 20 + 1 AS INT))"
_PLAN = "user_id * 10 + (CASE WHEN user_id % 3 = 0 THEN event_id % 5 ELSE event_id % 2 END)"
_INTERVAL = "CAST(EXTRACT(DAY FROM ts) * 24 + EXTRACT(HOUR FROM ts) AS BIGINT)"
_TEXT_OF_PART = _per("l_partkey", 2)
_USAGE_INDEX = "(CASE WHEN l_partkey % 11 = 0 THEN l_partkey + 1 ELSE l_partkey END)"


def _wait_snapshot(where: str) -> str:
    return f"""
SELECT {_USER_SERVER} AS server_id, {_WAIT} AS wait_type,
  COUNT(*) AS waiting_tasks_count, CAST(SUM({_WAIT_MS}) AS BIGINT) AS wait_time_ms,
  CAST(SUM({_CENTS} * (event_id % 3)) AS BIGINT) AS signal_wait_time_ms, MAX({_CENTS}) AS max_wait_time_ms
FROM {{events}} {where} GROUP BY 1, 2"""


def _index_usage(where: str) -> str:
    return f"""
SELECT {_per('index_id', 20)} AS server_id, index_id,
  CASE WHEN index_id % 6 = 0 THEN 0 ELSE n * (index_id % 50) END AS user_seeks,
  CASE WHEN index_id % 6 = 0 THEN 0 ELSE n * (index_id % 4) * 15 END AS user_scans,
  CASE WHEN index_id % 6 = 0 THEN 0 WHEN index_id % 9 = 1 THEN q * 20 ELSE n END AS user_lookups,
  q * 20 AS user_updates, last_seek AS last_user_seek
FROM (SELECT {_USAGE_INDEX} AS index_id, COUNT(*) AS n, CAST(SUM({_QTY}) AS BIGINT) AS q, MAX(l_shipdate) AS last_seek
  FROM {{lineitem}} {where} GROUP BY 1) u"""


def _index_physical(age: str) -> str:
    return f"""
SELECT {_PART_SERVER} AS server_id, p_partkey % 6 + 5 AS database_id, p_partkey AS index_id,
  CAST(10 * p_size{age} AS BIGINT) AS fragmentation_tenths, (p_partkey * 37) % 3000 AS page_count,
  (p_partkey * 911) % 200000 AS record_count
FROM {{part}}"""


def _index_operational(where: str) -> str:
    return f"""
SELECT {_LINE_SERVER} AS server_id, l_partkey AS index_id, l_linenumber AS partition_number,
  CAST(SUM({_QTY}) * 30 AS BIGINT) AS leaf_allocation_count
FROM {{lineitem}} {where} GROUP BY 1, 2, 3"""


# Earlier captures stop at a date, as counters read on that day would.
_EARLY_EVENTS = "WHERE ts < TIMESTAMP '2024-01-16 00:00:00'"
_EARLY_LINES = "WHERE l_shipdate < TIMESTAMP '1999-01-01 00:00:00'"

DERIVED = {
    "server_info": """
SELECT s_suppkey AS server_id, 4 + s_suppkey % 60 AS cpu_count,
  (16 + s_suppkey % 240) * 1048576 AS physical_memory_kb,
  CASE s_suppkey % 5 WHEN 0 THEN TIMESTAMP '2024-01-30 23:30:00' WHEN 1 THEN TIMESTAMP '2024-01-30 12:00:00'
    WHEN 2 THEN TIMESTAMP '2024-01-27 00:00:00' WHEN 3 THEN TIMESTAMP '2023-12-01 00:00:00'
    ELSE TIMESTAMP '2024-01-31 00:00:00' END AS start_time
FROM {supplier}""",
    "request_snapshot": f"""
SELECT {_EVENT_SERVER} AS server_id, {_SNAPSHOT} AS snapshot_ts, 51 + event_id AS session_id,
  event_id % 2 AS request_id, {_BLOCKER} AS blocking_session_id,
  CASE event_id % 3 WHEN 0 THEN 'runnable' WHEN 1 THEN 'running' ELSE 'suspended' END AS status,
  {_CENTS} * 10 AS cpu_time, {_CENTS} * 100 AS total_elapsed_time,
  {_CENTS} * (event_id % 10) AS wait_time, {_CENTS} * 3 AS logical_reads, {_CENTS} * 2 AS physical_reads,
  {_CENTS} AS writes, {_per('event_id', 10)} AS sql_handle, event_id % 6 + 5 AS database_id,
  {_WAIT} AS wait_type, (event_id % 20) * 2 AS statement_start_offset,
  CASE WHEN event_id % 4 = 0 THEN -1 ELSE 60 + (event_id % 20) * 2 END AS statement_end_offset
FROM {{events}}""",
    "session_snapshot": f"""
SELECT {_EVENT_SERVER} AS server_id, {_SNAPSHOT} AS snapshot_ts, 51 + event_id AS session_id,
  CONCAT('app_', CAST(event_id % 4 AS VARCHAR(20))) AS login_name,
  CONCAT('host_', CAST(event_id % 3 AS VARCHAR(20))) AS host_name, event_type AS program_name,
  CASE event_id % 3 WHEN 0 THEN 'sleeping' WHEN 1 THEN 'running' ELSE 'suspended' END AS status,
  CASE WHEN event_id % 20 = 0 THEN 0 ELSE 1 END AS is_user_process, event_id % 2 AS open_transaction_count,
  CASE event_id % 4 WHEN 0 THEN TIMESTAMP '2024-01-30 23:50:00' WHEN 1 THEN TIMESTAMP '2024-01-30 23:00:00'
    WHEN 2 THEN TIMESTAMP '2024-01-30 22:45:00' ELSE ts END AS last_request_end_time
FROM {{events}}""",
    "sql_text": "SELECT doc_id AS sql_handle, text FROM {documents}",
    "session_activity_log": f"""
SELECT {_USER_SERVER} AS server_id, ts AS collection_time, event_id AS session_id, event_type AS status,
  {_CENTS} * 10 AS cpu, {_CENTS} * 3 AS reads, {_CENTS} * 100 AS elapsed_time, {_WAIT} AS wait_info,
  {_BLOCKER} AS blocking_session_id, CONCAT('DB_', CAST(event_id % 6 + 5 AS VARCHAR(20))) AS database_name,
  props AS sql_text
FROM {{events}}""",
    "query_stats": f"""
SELECT {_LINE_SERVER} AS server_id, l_partkey * 10 + l_linenumber AS query_hash, {_TEXT_OF_PART} AS sql_handle,
  l_partkey % 6 + 5 AS database_id, COUNT(*) AS execution_count,
  CAST(SUM({_PRICE} * (1 + l_partkey % 60)) AS BIGINT) AS total_worker_time,
  CAST(SUM({_PRICE} * (2 + l_partkey % 90)) AS BIGINT) AS total_elapsed_time,
  CAST(SUM({_QTY} * (l_partkey % 9000)) AS BIGINT) AS total_logical_reads,
  MAX({_QTY}) * 1024 AS max_grant_kb, (l_partkey % 20) * 2 AS statement_start_offset,
  CASE WHEN l_partkey % 4 = 0 THEN -1 ELSE 60 + (l_partkey % 20) * 2 END AS statement_end_offset,
  MAX(l_shipdate) AS last_execution_time
FROM {{lineitem}} GROUP BY l_partkey, l_linenumber""",
    "proc_stats": f"""
SELECT {_LINE_SERVER} AS server_id, l_partkey % 6 + 5 AS database_id, l_partkey * 10 + l_linenumber AS object_id,
  CASE WHEN l_partkey % 13 = 0 THEN NULL
    ELSE CONCAT('proc_', CAST(l_partkey * 10 + l_linenumber AS VARCHAR(20))) END AS proc_name,
  COUNT(*) AS execution_count, CAST(SUM({_PRICE} * (1 + l_partkey % 30)) AS BIGINT) AS total_worker_time,
  CAST(SUM({_PRICE} * (2 + l_partkey % 40)) AS BIGINT) AS total_elapsed_time,
  CAST(SUM({_QTY} * (l_partkey % 900) * 10) AS BIGINT) AS total_logical_reads, MAX(l_shipdate) AS last_execution_time
FROM {{lineitem}} GROUP BY l_partkey, l_linenumber""",
    "trigger_stats": f"""
SELECT {_per('l_partkey', 100)} AS server_id, l_partkey % 6 + 5 AS database_id, l_partkey AS object_id,
  COUNT(*) AS execution_count, CAST(SUM({_PRICE} * (1 + l_partkey % 20)) AS BIGINT) AS total_worker_time,
  CAST(SUM({_PRICE} * (2 + l_partkey % 20)) AS BIGINT) AS total_elapsed_time, MAX(l_shipdate) AS last_execution_time
FROM {{lineitem}} GROUP BY l_partkey""",
    "trigger_dim": f"""
SELECT {_per('p_partkey', 100)} AS server_id, p_partkey % 6 + 5 AS database_id, p_partkey AS object_id,
  CONCAT('trg_', CAST(p_partkey AS VARCHAR(20))) AS name, p_partkey % 50 AS parent_id,
  CONCAT('t', CAST(p_partkey % 50 AS VARCHAR(20))) AS parent_name,
  CASE WHEN p_partkey % 15 = 0 THEN 'DATABASE' ELSE 'OBJECT_OR_COLUMN' END AS parent_class,
  CASE WHEN p_partkey % 7 = 0 THEN 1 ELSE 0 END AS is_disabled
FROM {{part}}""",
    "wait_snapshot": _wait_snapshot(""),
    "wait_snapshot_earlier": _wait_snapshot(_EARLY_EVENTS),
    "wait_series": f"""
SELECT server_id, wait_type, snapshot_ts, CAST(SUM(w) OVER running AS BIGINT) AS wait_time_ms,
  CAST(SUM(n) OVER running AS BIGINT) AS waiting_tasks_count
FROM (SELECT {_STORE_SERVER} AS server_id, {_WAIT} AS wait_type, DATE_TRUNC('day', ts) AS snapshot_ts,
    SUM({_WAIT_MS}) AS w, COUNT(*) AS n FROM {{events}} GROUP BY 1, 2, 3) x
WINDOW running AS (PARTITION BY server_id, wait_type,
  CASE WHEN snapshot_ts < TIMESTAMP '2024-01-15 00:00:00' THEN 0 ELSE 1 END ORDER BY snapshot_ts)""",
    "missing_index_group": f"""
SELECT {_per('p_partkey', 400)} AS server_id, p_partkey AS index_group_handle, p_partkey + 100000 AS index_handle
FROM {{part}}""",
    "missing_index_stats": f"""
SELECT {_per('p_partkey', 400)} AS server_id, p_partkey AS group_handle, p_size AS avg_total_user_cost,
  p_partkey % 100 AS avg_user_impact, p_partkey % 500 AS user_seeks, p_partkey % 7 AS user_scans
FROM {{part}}""",
    "missing_index_detail": f"""
SELECT {_per('p_partkey', 400)} AS server_id, p_partkey + 100000 AS index_handle, p_partkey % 6 + 5 AS database_id,
  CONCAT('t', CAST(p_partkey % 50 AS VARCHAR(20))) AS table_name,
  CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE CONCAT('[c', CAST(p_size AS VARCHAR(20)), '], [k]') END AS equality_columns,
  CASE WHEN p_partkey % 3 = 0 THEN '[d]' ELSE NULL END AS inequality_columns,
  CASE WHEN p_partkey % 4 = 0 THEN '[x], [y]' ELSE NULL END AS included_columns
FROM {{part}}""",
    "index_dim": f"""
SELECT {_PART_SERVER} AS server_id, p_partkey % 6 + 5 AS database_id,
  CONCAT('t', CAST(p_partkey % 50 AS VARCHAR(20))) AS table_name, p_partkey AS index_id,
  CASE WHEN p_partkey % 17 = 0 THEN NULL ELSE CONCAT('IX_', CAST(p_partkey AS VARCHAR(20))) END AS index_name,
  CASE WHEN p_partkey % 17 = 0 THEN 'HEAP' ELSE 'NONCLUSTERED' END AS type_desc,
  CASE WHEN p_partkey % 19 = 0 THEN 1 ELSE 0 END AS is_primary_key,
  CASE WHEN p_partkey % 23 = 0 THEN 1 ELSE 0 END AS is_unique_constraint,
  CASE WHEN p_partkey % 29 = 0 THEN 1 ELSE 0 END AS is_disabled
FROM {{part}}""",
    "index_usage": _index_usage(""),
    "index_usage_earlier": _index_usage(_EARLY_LINES),
    "index_physical": _index_physical(" + p_partkey % 10"),
    "index_physical_earlier": _index_physical(" / 2"),
    "index_operational": _index_operational(""),
    "index_operational_earlier": _index_operational(_EARLY_LINES),
    "stats_properties": f"""
SELECT {_PART_SERVER} AS server_id, p_partkey % 6 + 5 AS database_id, p_partkey AS stats_id,
  CONCAT('t', CAST(p_partkey % 50 AS VARCHAR(20))) AS table_name,
  CONCAT('ST_', CAST(p_partkey AS VARCHAR(20))) AS stats_name,
  rows_n AS total_rows, CAST(FLOOR(rows_n * p_size / 140) AS BIGINT) AS modification_counter,
  CAST(FLOOR(rows_n * (p_partkey % 100) / 100) AS BIGINT) AS rows_sampled,
  CASE WHEN p_partkey % 9 = 0 THEN 5 ELSE p_partkey % 200 END AS steps,
  CASE p_partkey % 4 WHEN 0 THEN TIMESTAMP '2024-01-30 00:00:00' WHEN 1 THEN TIMESTAMP '2024-01-22 00:00:00'
    WHEN 2 THEN TIMESTAMP '2024-01-01 00:00:00' ELSE TIMESTAMP '2024-01-29 12:00:00' END AS last_updated,
  CASE WHEN p_partkey % 10 = 0 THEN 1 ELSE 0 END AS has_filter,
  CASE WHEN p_partkey % 10 = 0 THEN '([c]>=(100000))' ELSE NULL END AS filter_definition
FROM (SELECT p_partkey, p_size, CASE WHEN p_partkey % 97 = 0 THEN 0 ELSE 500 * (1 + (p_partkey * 7) % 400) END AS rows_n
  FROM {{part}}) x""",
    "qs_query": f"""
SELECT DISTINCT {_STORE_SERVER} AS server_id, user_id AS query_id, user_id + 1000 AS query_text_id FROM {{events}}""",
    "qs_text": f"""
SELECT DISTINCT {_STORE_SERVER} AS server_id, user_id + 1000 AS query_text_id,
  CONCAT('select q', CAST(user_id AS VARCHAR(20)), ' from T', CAST(user_id % 5 AS VARCHAR(20))) AS query_sql_text
FROM {{events}}""",
    "qs_plan": f"""
SELECT {_STORE_SERVER} AS server_id, {_PLAN} AS plan_id, user_id AS query_id,
  MIN(ts) AS first_execution_time, MAX(ts) AS last_execution_time
FROM {{events}} GROUP BY 1, 2, 3""",
    "qs_interval": f"""
SELECT DISTINCT {_STORE_SERVER} AS server_id, {_INTERVAL} AS interval_id, DATE_TRUNC('hour', ts) AS start_time
FROM {{events}}""",
    "qs_runtime": f"""
SELECT {_STORE_SERVER} AS server_id, event_id AS runtime_id, {_PLAN} AS plan_id, {_INTERVAL} AS interval_id,
  {_CENTS} * 100 * (CASE WHEN ts >= TIMESTAMP '2024-01-30 00:00:00' AND user_id % 8 = 0 THEN 8
    WHEN ts >= TIMESTAMP '2024-01-30 00:00:00' AND user_id % 8 = 1 THEN 3 ELSE 1 END) * (1 + user_id % 200) AS avg_duration,
  {_CENTS} * 60 AS avg_cpu_time, {_CENTS} * (user_id % 7) AS avg_logical_io_reads,
  1 + event_id % 9 AS count_executions, ts AS last_execution_time
FROM {{events}}""",
    "qs_options": """
SELECT s_suppkey AS server_id, CASE s_suppkey % 5 WHEN 0 THEN 'OFF' WHEN 1 THEN 'READ_ONLY' ELSE 'READ_WRITE' END AS actual_state,
  (s_suppkey * 37) % 1000 AS current_mb, CAST(1000 AS BIGINT) AS max_mb,
  CASE s_suppkey % 2 WHEN 0 THEN 'AUTO' ELSE 'ALL' END AS capture_mode
FROM {supplier}""",
    "memory_grant": f"""
SELECT {_EVENT_SERVER} AS server_id, {_SNAPSHOT} AS snapshot_ts, 51 + event_id AS session_id,
  CASE WHEN event_id % 7 = 0 THEN NULL ELSE ts END AS grant_time, {_CENTS} * 64 AS requested_memory_kb,
  {_CENTS} * 64 AS granted_memory_kb, {_per(_CENTS + ' * 64 * (event_id % 7)', 6)} AS used_memory_kb,
  event_id % 3 AS queue_id, {_CENTS} AS wait_time_ms
FROM {{events}}""",
    "temp_file_space": """
SELECT s_suppkey AS server_id, (s_suppkey * 7919) % 400000 AS user_pages, (s_suppkey * 6007) % 200000 AS internal_pages,
  (s_suppkey * 3001) % 100000 AS version_pages, (s_suppkey * 997) % 500000 AS free_pages
FROM {supplier}""",
    "temp_task_space": f"""
SELECT {_EVENT_SERVER} AS server_id, {_SNAPSHOT} AS snapshot_ts, 51 + event_id AS session_id, event_id % 4 AS request_id,
  CASE WHEN event_id % 3 = 0 THEN 0 ELSE {_CENTS} * 2 END AS user_pages,
  CASE WHEN event_id % 3 = 0 THEN 0 ELSE {_CENTS} * 8 END AS internal_pages
FROM {{events}}""",
    "process_memory": """
SELECT s_suppkey AS server_id, (8 + s_suppkey % 200) * 1048576 AS physical_memory_in_use_kb,
  70 + s_suppkey % 30 AS memory_utilization_pct
FROM {supplier}""",
    "perf_counter": f"""
SELECT {_PART_SERVER} AS server_id,
  CASE WHEN p_partkey % 20 < 10 THEN 'SQLServer:Buffer Manager' ELSE 'SQLServer:Buffer Node' END AS object_name,
  CASE p_partkey % 10 WHEN 3 THEN 'Page life expectancy'
    ELSE CONCAT('counter ', CAST(p_partkey % 10 AS VARCHAR(20))) END AS counter_name,
  (p_partkey * 137) % 3000 AS cntr_value
FROM {{part}}""",
    "server_config": f"""
SELECT server_id, name, value_in_use AS configured_value, value_in_use FROM (
  SELECT {_PART_SERVER} AS server_id, {_SETTING} AS name,
    CASE p_partkey % 20 WHEN 0 THEN CASE WHEN {_PART_SERVER} % 3 = 0 THEN 2147483647 ELSE 8192 END
      WHEN 3 THEN {_PART_SERVER} % 60 ELSE {_PART_SERVER} % 2 END AS value_in_use
  FROM {{part}}) x""",
    "buffer_page": """
SELECT l_suppkey AS server_id, l_partkey % 12 AS database_id, l_orderkey * 10 + l_linenumber AS page_id FROM {lineitem}""",
    "file_dim": f"""
SELECT {_PART_SERVER} AS server_id, p_partkey % 10 + 1 AS database_id, p_partkey AS file_id,
  CONCAT('f', CAST(p_partkey AS VARCHAR(20))) AS file_name, {_PART_SERVER} * 15 + p_partkey % 15 AS volume_id,
  {_per('p_partkey', 10)} % 2 AS type, (p_partkey * 99991) % 3000000 AS size_pages, (p_partkey * 773) % 100000 AS growth,
  CASE WHEN p_partkey % 4 = 0 THEN 1 ELSE 0 END AS is_percent_growth
FROM {{part}}""",
    "file_io": f"""
SELECT {_LINE_SERVER} AS server_id, l_partkey % 10 + 1 AS database_id, l_partkey AS file_id,
  SUM(CASE WHEN l_returnflag = 'N' THEN 1 ELSE 0 END) * (CASE WHEN l_partkey % 13 = 0 THEN 0 ELSE 1 END) AS num_of_reads,
  SUM(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS num_of_writes,
  SUM(CASE WHEN l_returnflag = 'N' THEN {_QTY} ELSE 0 END) * (l_partkey % 4) AS io_stall_read_ms,
  SUM(CASE WHEN l_returnflag = 'R' THEN {_QTY} ELSE 0 END) * (l_partkey % 3) AS io_stall_write_ms,
  SUM({_PRICE}) * 1000 AS num_of_bytes_read, SUM({_PRICE}) * 300 AS num_of_bytes_written
FROM {{lineitem}} GROUP BY l_partkey""",
    "volume": f"""
SELECT {_per('c_custkey', 15)} AS server_id, c_custkey AS volume_id,
  CONCAT('V', CAST(c_custkey % 15 AS VARCHAR(20))) AS mount_point, CAST(1000 AS BIGINT) * 1073741824 AS total_bytes,
  ((c_custkey * 37) % 300 + 10) * 1073741824 AS available_bytes
FROM {{customer}}""",
    "cached_plan": f"""
SELECT {_per('o_custkey', 15)} AS server_id, o_orderkey AS plan_handle,
  CASE o_orderstatus WHEN 'F' THEN 'Adhoc' WHEN 'O' THEN 'Prepared'
    ELSE CASE WHEN o_orderkey % 5 = 0 THEN 'View' ELSE 'Proc' END END AS objtype,
  CASE WHEN (o_orderstatus = 'F' AND o_orderkey % 2 = 0) OR (o_orderstatus = 'O' AND o_orderkey % 4 = 0) THEN 1
    ELSE 2 + CAST(ROUND(o_totalprice) AS BIGINT) END AS usecounts,
  CAST(ROUND(o_totalprice) AS BIGINT) AS size_in_bytes,
  CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderkey % 6 + 5 END AS database_id,
  {_per('o_orderkey', 15)} AS sql_handle
FROM {{orders}}""",
    "database_dim": f"""
SELECT {_per('c_custkey', 15)} AS server_id, c_custkey % 15 + 1 AS database_id,
  CONCAT('DB_', CAST(c_custkey % 15 + 1 AS VARCHAR(20))) AS name,
  CASE WHEN c_custkey % 9 = 8 THEN 'OFFLINE' ELSE 'ONLINE' END AS state_desc,
  CASE c_custkey % 2 WHEN 0 THEN 'FULL' ELSE 'SIMPLE' END AS recovery_model,
  CASE c_custkey % 4 WHEN 0 THEN 'NOTHING' WHEN 1 THEN 'LOG_BACKUP' WHEN 2 THEN 'ACTIVE_TRANSACTION'
    ELSE 'CHECKPOINT' END AS log_reuse_wait,
  CASE WHEN c_custkey % 7 = 0 THEN 1 ELSE 0 END AS is_auto_shrink_on,
  CASE WHEN c_custkey % 5 = 0 THEN 1 ELSE 0 END AS is_auto_close_on,
  CASE WHEN c_custkey % 3 = 0 THEN 'NONE' ELSE 'CHECKSUM' END AS page_verify,
  CASE c_custkey % 4 WHEN 0 THEN TIMESTAMP '2024-01-30 00:00:00' WHEN 1 THEN TIMESTAMP '2024-01-20 00:00:00'
    WHEN 2 THEN TIMESTAMP '2023-11-01 00:00:00' ELSE NULL END AS last_good_check_time
FROM {{customer}}""",
    "backupset": f"""
SELECT o_orderkey AS backup_set_id, {_per('o_custkey', 150)} AS server_id,
  CONCAT('DB_', CAST(o_custkey % 3 + 1 AS VARCHAR(20))) AS database_name,
  CASE WHEN o_orderstatus = 'F' AND o_custkey % 150 % 3 < 2 THEN 'D' WHEN o_orderstatus = 'O' THEN 'I' ELSE 'L' END AS type,
  o_orderdate AS backup_finish_date, CAST(ROUND(o_totalprice * 100) AS BIGINT) * 400 AS backup_size,
  CAST(ROUND(o_totalprice * 100) AS BIGINT) * (60 + o_orderkey % 90) AS compressed_backup_size
FROM {{orders}}""",
    "job_dim": f"""
SELECT DISTINCT {_USER_SERVER} AS server_id, user_id AS job_id, CONCAT('job_', CAST(user_id AS VARCHAR(20))) AS name
FROM {{events}}""",
    "job_history": f"""
SELECT {_USER_SERVER} AS server_id, event_id AS instance_id, user_id AS job_id,
  CONCAT('step_', CAST(event_id % 4 AS VARCHAR(20))) AS step_name,
  CASE event_type WHEN 'error' THEN 0 WHEN 'view' THEN 2 WHEN 'signup' THEN 3 ELSE 1 END AS run_status,
  CAST(EXTRACT(YEAR FROM ts) * 10000 + EXTRACT(MONTH FROM ts) * 100 + EXTRACT(DAY FROM ts) AS BIGINT) AS run_date,
  CAST(EXTRACT(HOUR FROM ts) * 10000 + EXTRACT(MINUTE FROM ts) * 100 + FLOOR(EXTRACT(SECOND FROM ts)) AS BIGINT) AS run_time,
  props AS message
FROM {{events}}""",
    "log_vlf": f"""
SELECT {_per('o_custkey', 150)} AS server_id,
  CASE WHEN o_custkey % 150 < 105 THEN 5 WHEN o_custkey % 150 < 140 THEN 6 ELSE 7 END AS database_id,
  o_orderkey AS vlf_id, CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END AS vlf_active,
  CAST(ROUND(o_totalprice) AS BIGINT) AS vlf_size_kb
FROM {{orders}}""",
    "command_log": f"""
SELECT {_USER_SERVER} AS server_id, event_id AS command_id,
  CONCAT('DB_', CAST(event_id % 6 + 5 AS VARCHAR(20))) AS database_name,
  CONCAT('t', CAST(event_id % 50 AS VARCHAR(20))) AS table_name,
  CONCAT('IX_', CAST(user_id AS VARCHAR(20))) AS index_name, event_type AS command_type, ts AS start_time,
  CASE event_id % 3 WHEN 0 THEN ts + INTERVAL '10' MINUTE WHEN 1 THEN ts + INTERVAL '2' HOUR
    ELSE ts + INTERVAL '59' MINUTE END AS end_time,
  CASE WHEN event_type = 'error' THEN 1000 + event_id % 50 ELSE NULL END AS error_number,
  CASE WHEN event_type = 'error' THEN props ELSE NULL END AS error_message
FROM {{events}}""",
    "error_log": "SELECT doc_id AS log_id, source AS log_type, text FROM {documents}",
    "partition_rows": f"""
SELECT {_LINE_SERVER} AS server_id, CONCAT('t', CAST(l_partkey AS VARCHAR(20))) AS table_name,
  l_linenumber AS partition_number, COUNT(*) AS row_count
FROM {{lineitem}} GROUP BY 1, 2, 3""",
    "log_session": f"""
SELECT {_STORE_SERVER} AS server_id, ts AS snapshot_ts, event_id % 400 AS session_id,
  {_BLOCKER} AS blocking_session_id, {_CENTS} * 10 AS cpu_time
FROM {{events}}""",
}


def base_tables_of(statement: str) -> list[str]:
    return sorted(set(re.findall(r"\{(\w+)\}", statement)))
