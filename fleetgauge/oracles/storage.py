from __future__ import annotations

from fleetgauge.oracles.common import big, case, idiv, mb, pct, rdiv, sql
from fleetgauge.oracles.sessions import DB

GB = 1024**3
SEGMENTS = case(("segments > 1000", "CRITICAL", "severe_fragmentation"), ("segments > 200", "ATTENTION", "above_recommended"))


def _read(limit: int) -> str:
    return f"num_of_reads > 0 AND {idiv('io_stall_read_ms', 'num_of_reads')} > {limit}"


def _write(limit: int) -> str:
    return f"num_of_writes > 0 AND {idiv('io_stall_write_ms', 'num_of_writes')} > {limit}"


ORACLES = {
    "q17a_file_latency": sql(f"""
SELECT i.server_id, i.database_id, i.file_id, f.file_name, f.type,
 CASE WHEN num_of_reads = 0 THEN 0 ELSE {rdiv('io_stall_read_ms', 'num_of_reads', 2)} END AS avg_read_ms,
 CASE WHEN num_of_writes = 0 THEN 0 ELSE {rdiv('io_stall_write_ms', 'num_of_writes', 2)} END AS avg_write_ms,
 {big('num_of_reads')} AS num_of_reads, {big('num_of_writes')} AS num_of_writes,
 {rdiv('num_of_bytes_read', '1048576', 1)} AS read_mb, {rdiv('num_of_bytes_written', '1048576', 1)} AS written_mb,
 {case((_read(50), "CRITICAL", "read_over_50ms"), (_read(20), "ATTENTION", "read_over_20ms"),
  (_write(50), "CRITICAL", "write_over_50ms"), (_write(20), "ATTENTION", "write_over_20ms"))}
FROM file_io i JOIN file_dim f ON f.server_id = i.server_id AND f.database_id = i.database_id AND f.file_id = i.file_id""",
        "file_io", "file_dim"),
    "q17b_volume_space": sql(f"""
SELECT DISTINCT v.server_id, v.mount_point, {idiv('v.total_bytes', GB)} AS total_gb, {idiv('v.available_bytes', GB)} AS free_gb,
 {pct('v.available_bytes', 'v.total_bytes')} AS free_pct,
 {case(("v.available_bytes < v.total_bytes * 0.05", "CRITICAL", "under_5_pct"),
  ("v.available_bytes < v.total_bytes * 0.10", "CRITICAL", "under_10_pct"),
  ("v.available_bytes < v.total_bytes * 0.20", "ATTENTION", "under_20_pct"))}
FROM file_dim f JOIN volume v ON v.server_id = f.server_id AND v.volume_id = f.volume_id""", "file_dim", "volume"),
    "q20b_log_reuse": sql(f"""
SELECT server_id, name, recovery_model, log_reuse_wait, {case(("log_reuse_wait = 'LOG_BACKUP'", "ATTENTION", "log_backup_pending"),
 ("log_reuse_wait = 'ACTIVE_TRANSACTION'", "ATTENTION", "long_transaction"), ("log_reuse_wait = 'NOTHING'", "OK", "ok"),
 otherwise=("VERIFY", "other"))} FROM database_dim WHERE state_desc = 'ONLINE'""", "database_dim"),
    "q20c_log_vs_data": sql(f"""
SELECT server_id, name, data_mb, log_mb, {case(("log_pages > data_pages * 2", "CRITICAL", "log_over_twice_data"),
 ("log_pages > data_pages", "ATTENTION", "log_over_data"))} FROM (
 SELECT d.server_id, d.name, {big(f"sum(CASE WHEN f.type = 0 THEN {mb('f.size_pages')} ELSE 0 END)")} AS data_mb,
  {big(f"sum(CASE WHEN f.type = 1 THEN {mb('f.size_pages')} ELSE 0 END)")} AS log_mb,
  sum(CASE WHEN f.type = 0 THEN f.size_pages ELSE 0 END) AS data_pages,
  sum(CASE WHEN f.type = 1 THEN f.size_pages ELSE 0 END) AS log_pages
 FROM database_dim d JOIN file_dim f ON f.server_id = d.server_id AND f.database_id = d.database_id
 WHERE d.state_desc = 'ONLINE' GROUP BY 1, 2) y""", "database_dim", "file_dim"),
    "q24a_vlf_by_db": sql(f"""
SELECT c.*, d.name AS database_name, {SEGMENTS} FROM (
 SELECT server_id, database_id, count(*) AS segments, {big('sum(CASE WHEN vlf_active = 1 THEN 1 ELSE 0 END)')} AS active
 FROM log_vlf GROUP BY ALL) c {DB.format('c')}""", "log_vlf", "database_dim"),
    "q24b_vlf_size": sql(f"""
SELECT *, {SEGMENTS} FROM (SELECT server_id, database_id, count(*) AS segments,
 {rdiv('sum(vlf_size_kb)', '1024', 1)} AS total_mb FROM log_vlf GROUP BY ALL) y""", "log_vlf"),
    "q25_autogrowth": sql(f"""
SELECT server_id, database_id, file_name, type, {mb('size_pages')} AS size_mb,
 CASE WHEN is_percent_growth = 1 THEN CAST(growth AS VARCHAR) || '%' ELSE CAST({mb('growth')} AS VARCHAR) || ' MB' END AS autogrowth,
 CASE WHEN is_percent_growth = 1 THEN 0 WHEN {mb('growth')} < 256 THEN 1 ELSE 2 END AS sort_bucket,
 {case((f"is_percent_growth = 1 AND {mb('size_pages')} > 10240", "CRITICAL", "percent_growth_over_10gb"),
  ("is_percent_growth = 1", "ATTENTION", "percent_growth"),
  (f"{mb('growth')} < 256 AND type = 0", "ATTENTION", "data_step_under_256mb"),
  (f"{mb('growth')} < 512 AND type = 1", "ATTENTION", "log_step_under_512mb"))}
FROM file_dim WHERE database_id > 4""", "file_dim"),
    "q33_io_share": sql(f"""
SELECT *, {case(("read_share_pct > 70", "ATTENTION", "dominates_reads"), ("write_share_pct > 70", "ATTENTION", "dominates_writes"))} FROM (
 SELECT i.server_id, i.database_id, d.name AS database_name, {big('sum(num_of_reads)')} AS reads, {big('sum(num_of_writes)')} AS writes,
  {rdiv('sum(num_of_bytes_read)', str(GB), 2)} AS read_gb, {rdiv('sum(num_of_bytes_written)', str(GB), 2)} AS written_gb,
  {pct('sum(num_of_reads)', 'sum(sum(num_of_reads)) OVER (PARTITION BY i.server_id)', 1)} AS read_share_pct,
  {pct('sum(num_of_writes)', 'sum(sum(num_of_writes)) OVER (PARTITION BY i.server_id)', 1)} AS write_share_pct
 FROM file_io i JOIN database_dim d ON d.server_id = i.server_id AND d.database_id = i.database_id
 GROUP BY i.server_id, i.database_id, d.name) y""", "file_io", "database_dim"),
}
