"""Declared schemas of the telemetry tables (reads never infer a schema)."""

from __future__ import annotations

TELEMETRY_SCHEMAS = {
    "server_info": (
        "server_id bigint, snapshot_ts timestamp, cpu_count bigint, physical_memory_kb bigint, start_time timestamp"
    ),
    "request_snapshot": (
        "server_id bigint, snapshot_ts timestamp, session_id bigint, request_id bigint, blocking_session_id "
        "bigint, status string, cpu_time bigint, total_elapsed_time bigint, wait_time bigint, logical_reads "
        "bigint, physical_reads bigint, writes bigint, sql_handle bigint, database_id bigint, wait_type "
        "string, statement_start_offset bigint, statement_end_offset bigint"
    ),
    "session_snapshot": (
        "server_id bigint, snapshot_ts timestamp, session_id bigint, login_name string, host_name string, "
        "program_name string, status string, is_user_process int, open_transaction_count bigint, "
        "last_request_end_time timestamp"
    ),
    "sql_text": (
        "sql_handle bigint, text string"
    ),
    "session_activity_log": (
        "server_id bigint, collection_time timestamp, session_id bigint, status string, cpu bigint, reads "
        "bigint, elapsed_time bigint, wait_info string, blocking_session_id bigint, database_name string, "
        "sql_text string"
    ),
    "query_stats": (
        "server_id bigint, snapshot_ts timestamp, query_hash bigint, sql_handle bigint, database_id bigint, execution_count bigint, "
        "total_worker_time bigint, total_elapsed_time bigint, total_logical_reads bigint, max_grant_kb "
        "bigint, statement_start_offset bigint, statement_end_offset bigint, last_execution_time timestamp"
    ),
    "proc_stats": (
        "server_id bigint, snapshot_ts timestamp, database_id bigint, object_id bigint, proc_name string, execution_count bigint, "
        "total_worker_time bigint, total_elapsed_time bigint, total_logical_reads bigint, last_execution_time "
        "timestamp"
    ),
    "trigger_stats": (
        "server_id bigint, snapshot_ts timestamp, database_id bigint, object_id bigint, execution_count bigint, total_worker_time "
        "bigint, total_elapsed_time bigint, last_execution_time timestamp"
    ),
    "trigger_dim": (
        "server_id bigint, database_id bigint, object_id bigint, name string, parent_id bigint, parent_name "
        "string, parent_class string, is_disabled int, create_date timestamp, modify_date timestamp"
    ),
    "wait_snapshot": (
        "server_id bigint, snapshot_ts timestamp, wait_type string, waiting_tasks_count bigint, wait_time_ms bigint, "
        "signal_wait_time_ms bigint, max_wait_time_ms bigint"
    ),
    "wait_series": (
        "server_id bigint, wait_type string, snapshot_ts timestamp, wait_time_ms bigint, waiting_tasks_count "
        "bigint"
    ),
    "missing_index_group": (
        "server_id bigint, snapshot_ts timestamp, index_group_handle bigint, index_handle bigint"
    ),
    "missing_index_stats": (
        "server_id bigint, snapshot_ts timestamp, group_handle bigint, avg_total_user_cost int, avg_user_impact bigint, user_seeks "
        "bigint, user_scans bigint"
    ),
    "missing_index_detail": (
        "server_id bigint, snapshot_ts timestamp, index_handle bigint, database_id bigint, table_name string, equality_columns "
        "string, inequality_columns string, included_columns string"
    ),
    "index_dim": (
        "server_id bigint, database_id bigint, table_name string, index_id bigint, index_name string, "
        "type_desc string, is_primary_key int, is_unique_constraint int, is_disabled int"
    ),
    "index_usage": (
        "server_id bigint, snapshot_ts timestamp, index_id bigint, user_seeks bigint, user_scans bigint, user_lookups bigint, "
        "user_updates bigint, last_user_seek timestamp"
    ),
    "index_physical": (
        "server_id bigint, snapshot_ts timestamp, database_id bigint, index_id bigint, fragmentation_tenths bigint, page_count "
        "bigint, record_count bigint"
    ),
    "index_operational": (
        "server_id bigint, snapshot_ts timestamp, index_id bigint, partition_number int, leaf_allocation_count bigint"
    ),
    "stats_properties": (
        "server_id bigint, snapshot_ts timestamp, database_id bigint, stats_id bigint, table_name string, stats_name string, "
        "total_rows bigint, modification_counter bigint, rows_sampled bigint, steps bigint, last_updated "
        "timestamp, has_filter int, filter_definition string"
    ),
    "qs_query": (
        "server_id bigint, query_id bigint, query_text_id bigint"
    ),
    "qs_text": (
        "server_id bigint, query_text_id bigint, query_sql_text string"
    ),
    "qs_plan": (
        "server_id bigint, plan_id bigint, query_id bigint, first_execution_time timestamp, "
        "last_execution_time timestamp"
    ),
    "qs_interval": (
        "server_id bigint, interval_id bigint, start_time timestamp"
    ),
    "qs_runtime": (
        "server_id bigint, runtime_id bigint, plan_id bigint, interval_id bigint, avg_duration bigint, "
        "avg_cpu_time bigint, avg_logical_io_reads bigint, count_executions bigint, last_execution_time "
        "timestamp"
    ),
    "qs_options": (
        "server_id bigint, snapshot_ts timestamp, actual_state string, current_mb bigint, max_mb bigint, capture_mode string"
    ),
    "memory_grant": (
        "server_id bigint, snapshot_ts timestamp, session_id bigint, grant_time timestamp, "
        "requested_memory_kb bigint, granted_memory_kb bigint, used_memory_kb bigint, queue_id bigint, "
        "wait_time_ms bigint"
    ),
    "temp_file_space": (
        "server_id bigint, snapshot_ts timestamp, user_pages bigint, internal_pages bigint, version_pages bigint, free_pages bigint"
    ),
    "temp_task_space": (
        "server_id bigint, snapshot_ts timestamp, session_id bigint, request_id bigint, user_pages bigint, "
        "internal_pages bigint"
    ),
    "process_memory": (
        "server_id bigint, snapshot_ts timestamp, physical_memory_in_use_kb bigint, memory_utilization_pct bigint"
    ),
    "perf_counter": (
        "server_id bigint, snapshot_ts timestamp, object_name string, counter_name string, cntr_value bigint"
    ),
    "server_config": (
        "server_id bigint, snapshot_ts timestamp, name string, configured_value bigint, value_in_use bigint"
    ),
    "buffer_page": (
        "server_id bigint, snapshot_ts timestamp, database_id bigint, page_id bigint"
    ),
    "file_dim": (
        "server_id bigint, database_id bigint, file_id bigint, file_name string, volume_id bigint, type "
        "bigint, size_pages bigint, growth bigint, is_percent_growth int"
    ),
    "file_io": (
        "server_id bigint, snapshot_ts timestamp, database_id bigint, file_id bigint, num_of_reads bigint, num_of_writes bigint, "
        "io_stall_read_ms bigint, io_stall_write_ms bigint, num_of_bytes_read bigint, num_of_bytes_written "
        "bigint"
    ),
    "volume": (
        "server_id bigint, snapshot_ts timestamp, volume_id bigint, mount_point string, total_bytes bigint, available_bytes bigint"
    ),
    "cached_plan": (
        "server_id bigint, snapshot_ts timestamp, plan_handle bigint, objtype string, usecounts bigint, size_in_bytes bigint, "
        "database_id bigint, sql_handle bigint"
    ),
    "database_dim": (
        "server_id bigint, database_id bigint, name string, state_desc string, recovery_model string, "
        "log_reuse_wait string, is_auto_shrink_on int, is_auto_close_on int, page_verify string, "
        "last_good_check_time timestamp"
    ),
    "backupset": (
        "backup_set_id bigint, server_id bigint, database_name string, type string, backup_finish_date "
        "timestamp, backup_size bigint, compressed_backup_size bigint"
    ),
    "job_dim": (
        "server_id bigint, job_id bigint, name string"
    ),
    "job_history": (
        "server_id bigint, instance_id bigint, job_id bigint, step_name string, run_status int, run_date "
        "bigint, run_time bigint, message string"
    ),
    "log_vlf": (
        "server_id bigint, snapshot_ts timestamp, database_id int, vlf_id bigint, vlf_active int, vlf_size_kb bigint"
    ),
    "command_log": (
        "server_id bigint, command_id bigint, database_name string, table_name string, index_name string, "
        "command_type string, start_time timestamp, end_time timestamp, error_number bigint, error_message "
        "string"
    ),
    "error_log": (
        "server_id bigint, log_id bigint, log_type string, event_ts timestamp, text string"
    ),
    "partition_rows": (
        "server_id bigint, snapshot_ts timestamp, table_name string, partition_number int, row_count bigint"
    ),
    "log_session": (
        "server_id bigint, snapshot_ts timestamp, session_id bigint, blocking_session_id bigint, cpu_time "
        "bigint"
    ),
    # Written by the collector and the baseline captures.
    "log_wait": (
        "server_id bigint, collected_at timestamp, rank int, wait_type string, waiting_tasks_count bigint, "
        "wait_time_ms bigint, signal_wait_time_ms bigint, share_pct decimal(5,2)"
    ),
    "log_block": (
        "server_id bigint, snapshot_ts timestamp, blocking_session_id bigint, blocker_query string, "
        "blocked_session_id bigint, blocked_query string, wait_type string, wait_seconds bigint, "
        "collected_at timestamp"
    ),
    "baseline_index": (
        "phase string, captured_at timestamp, server_id bigint, snapshot_ts timestamp, database_id bigint, table_name string, "
        "index_name string, seeks bigint, scans bigint, lookups bigint, updates bigint, "
        "counters_since timestamp"
    ),
    "baseline_frag": (
        "phase string, captured_at timestamp, server_id bigint, snapshot_ts timestamp, database_id bigint, table_name string, "
        "index_name string, fragmentation_pct decimal(5,1), page_count bigint, record_count bigint, "
        "page_splits bigint"
    ),
    "baseline_wait": (
        "phase string, captured_at timestamp, server_id bigint, snapshot_ts timestamp, wait_type string, wait_time_ms bigint, "
        "waiting_tasks bigint"
    ),
}

#: Columns that live exports hold in another type than the declared one: handles and hashes
#: are binary (hexadecimal text in formats without binary), averages and costs are floats,
#: and fragmentation is a percentage under another name.
HANDLE = "handle"
EXPORTED_TYPES = {
    "request_snapshot": {"sql_handle": HANDLE},
    "sql_text": {"sql_handle": HANDLE},
    "query_stats": {"query_hash": HANDLE, "sql_handle": HANDLE},
    "cached_plan": {"plan_handle": HANDLE, "sql_handle": HANDLE},
    "missing_index_stats": {"avg_total_user_cost": "double", "avg_user_impact": "double"},
    "index_physical": {"fragmentation_tenths": "double"},
    "qs_runtime": {"avg_duration": "double", "avg_cpu_time": "double", "avg_logical_io_reads": "double"},
}
EXPORTED_NAMES = {("index_physical", "fragmentation_tenths"): "fragmentation_pct"}
