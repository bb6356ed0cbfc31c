from __future__ import annotations

from datetime import datetime, timedelta
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from fleetgauge.plans import baseline, blocking, findings, history, sessions, waiting
from fleetgauge.plans.registry import REPORTS, exported_often
from fleetgauge.session import checkpoint_root, work_path
from fleetgauge.sources.derived import DERIVED
from fleetgauge.sources.schemas import EXPORTED_NAMES, EXPORTED_TYPES, HANDLE, TELEMETRY_SCHEMAS
from fleetgauge.sources.sinks import append_by_date, save_capture, save_phase, schema_of
from fleetgauge.sources.telemetry import Telemetry

NOW = datetime(2024, 1, 31)


def types(schema) -> dict:
    return {f.name: f.dataType for f in schema}


def test_derived_tables_have_the_declared_schemas(spark, telemetry):
    for name in DERIVED:
        declared = TELEMETRY_SCHEMAS[name.removesuffix("_earlier")]
        # the derived tables are one export each: they leave out what only exports have
        wanted = types(spark.createDataFrame([], declared).schema)
        found = types(telemetry[name].schema)
        exported = {"snapshot_ts", "create_date", "modify_date", "event_ts", "server_id"} - set(found)
        assert found == {k: v for k, v in wanted.items() if k not in exported}, name


@pytest.mark.parametrize("file_format", ["parquet", "json"])
def test_reports_run_on_exported_files(spark, telemetry, tmp_path, file_format):
    for name in ("wait_snapshot", "server_info"):
        exported = telemetry[name].withColumn("snapshot_ts", F.lit("2024-01-31 00:00:00").cast("timestamp"))
        exported.write.format(file_format).save(str(tmp_path / name))
    files = Telemetry.from_files(spark, str(tmp_path), file_format)
    got, want = waiting.wait_ranking(files).drop("snapshot_ts"), waiting.wait_ranking(telemetry)
    assert got.count() == want.count() and got.exceptAll(want).isEmpty()


@pytest.mark.parametrize("file_format", ["parquet", "json"])
def test_reports_run_on_exports_as_they_are(spark, telemetry, tmp_path, file_format):
    """Binary handles (hexadecimal in text formats), float averages and costs, fragmentation in percent: the same reports."""
    binary = file_format == "parquet"
    tables = "request_snapshot session_snapshot sql_text query_stats cached_plan missing_index_group missing_index_stats missing_index_detail index_physical index_dim qs_runtime qs_query qs_text qs_plan qs_interval database_dim".split()
    for name in tables:
        rows = telemetry[name]
        for column, kind in EXPORTED_TYPES.get(name, {}).items():
            if kind == HANDLE:
                handle = F.concat(F.lit("02"), F.lpad(F.hex(F.col(column)), 38, "0"))
                rows = rows.withColumn(column, F.unhex(handle) if binary else F.concat(F.lit("0x"), F.lower(handle)))
            elif (name, column) in EXPORTED_NAMES:
                rows = rows.withColumn(EXPORTED_NAMES[name, column], F.col(column).cast("double") / 10).drop(column)
            else:
                rows = rows.withColumn(column, F.col(column).cast("double"))
        rows.write.format(file_format).option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").save(str(tmp_path / name))
    exports = Telemetry.from_exports(spark, str(tmp_path), file_format)
    handles = {"sql_handle", "query_hash", "plan_handle"}
    for name in ("q03_active_requests", "q04a_query_cpu", "q08_missing_indexes", "q09a_fragmentation", "q13b_qs_top_duration", "q19a_cached_plans", "q34a_regressions"):
        want = REPORTS[name](telemetry)
        got = REPORTS[name](exports)
        shown = [c for c in want.columns if c not in handles]
        same = lambda df: df.select(*[F.col(c).cast("double").alias(c) if df.schema[c].dataType.typeName() in ("decimal", "double", "long", "integer") else F.col(c) for c in shown])
        got, want = same(got), same(want)
        assert want.count() > 0 and got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty(), name


def test_error_log_from_text_files(spark, tmp_path):
    (tmp_path / "log.txt").write_text("Server is starting up\nnothing\nnow ready; IS STARTING\n")
    log = spark.read.text(str(tmp_path)).select(
        F.monotonically_increasing_id().alias("log_id"), F.lit("server").alias("log_type"), F.col("value").alias("text")
    )
    t = Telemetry.from_frames(spark, error_log=log)
    got = sorted((r["phrase"], r["line"]) for r in history.restart_events(t, ("is starting", "now ready")).collect())
    assert got == [("is starting", "Server is starting up"), ("is starting", "now ready; IS STARTING"), ("now ready", "now ready; IS STARTING")]


def test_baseline_kept_on_disk(spark, telemetry, tmp_path):
    path = str(tmp_path / "baseline_wait")
    save_phase(baseline.capture_waits(telemetry, "before", NOW, waits="wait_snapshot_earlier"), path)
    for _ in range(2):  # capturing again replaces the phase
        save_phase(baseline.capture_waits(telemetry, "7d", NOW), path)
    stored = spark.read.parquet(path)
    assert stored.where("phase = '7d'").count() == baseline.capture_waits(telemetry, "7d", NOW).count()
    assert baseline.wait_change(stored).count() > 0
    assert baseline.wait_change(stored, "24h").isEmpty()  # that phase was never captured


def test_two_captures_of_a_phase_without_snapshots(spark, telemetry, tmp_path):
    path = str(tmp_path / "baseline_wait")
    for day in (28, 31):
        save_phase(baseline.capture_waits(telemetry, "before", NOW.replace(day=day), waits="wait_snapshot_earlier"), path)
        save_phase(baseline.capture_waits(telemetry, "7d", NOW.replace(day=day)), path)
    stored = spark.read.parquet(path).drop("snapshot_ts")
    assert baseline.wait_change(stored).count() == REPORTS["q28g_wait_change"](telemetry).count()


def test_capture_for_a_later_delta(spark, telemetry, tmp_path):
    saved = save_capture(waiting.capture_waits(telemetry, "wait_snapshot_earlier"), str(tmp_path), "c1")
    direct = waiting.wait_delta(waiting.capture_waits(telemetry, "wait_snapshot_earlier"), telemetry["wait_snapshot"])
    assert waiting.wait_delta(saved, telemetry["wait_snapshot"]).exceptAll(direct).isEmpty()


def test_capture_allow_list(telemetry):
    some = baseline.capture_index_usage(telemetry, "before", NOW, tables=["t1", "t2"])
    assert {r[0] for r in some.select("table_name").distinct().collect()} == {"t1", "t2"}


def test_date_partitions_are_pruned(spark, telemetry, tmp_path):
    path = str(tmp_path / "log")
    append_by_date(telemetry["log_session"], path, "snapshot_ts")
    plan = spark.read.parquet(path).where("dt = DATE '2024-01-05'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(dt" in plan


def test_schema_of_a_report(telemetry):
    assert schema_of(history.hourly_sessions(telemetry, NOW)).startswith("server_id BIGINT,day TIMESTAMP")


def test_feed_priorities(telemetry):
    feed = findings.findings_feed(telemetry, {n: REPORTS[n] for n in ("q09a_fragmentation", "q16b_page_life")}, max_priority=200)
    rows = {(r["severity"], r["priority"], r["band"]) for r in feed.select("severity", "priority", "band").distinct().collect()}
    assert {("REBUILD", 10, "act_now"), ("REORGANIZE", 50, "plan")} <= rows
    assert findings.findings_feed(telemetry, {"q16b_page_life": REPORTS["q16b_page_life"]}, 200, server_id=3).count() == 1


def test_feed_keeps_all_bands_snapshots_and_names(telemetry):
    feed = findings.findings_feed(telemetry, {n: REPORTS[n] for n in ("q07a_session_groups", "q09a_fragmentation", "q18_stale_stats")})
    assert {"note", "plan", "act_now"} == {r[0] for r in feed.select("band").distinct().collect()}
    assert feed.where("report = 'q07a_session_groups' AND snapshot_ts IS NULL").isEmpty()
    assert feed.where("report = 'q07a_session_groups'").count() == REPORTS["q07a_session_groups"](telemetry).count()
    by_id = feed.where("report <> 'q07a_session_groups'")
    assert {r[0][:3] for r in by_id.select("database").distinct().collect() if r[0]} == {"DB_"}


def test_feed_by_database(telemetry):
    feed = findings.findings_feed(telemetry, {"q21_integrity_age": REPORTS["q21_integrity_age"]}, 200, databases=["DB_6"])
    assert {r[0] for r in feed.select("database").distinct().collect()} == {"DB_6"}


def test_written_tables_have_the_declared_schemas(spark, telemetry):
    exported = telemetry.replaced(**{
        t: telemetry[t].withColumn("snapshot_ts", F.lit("2024-01-30").cast("timestamp")) for t in ("index_usage", "index_physical", "wait_snapshot")
    })
    written = {
        "log_wait": waiting.collected_waits(telemetry, NOW),
        "log_block": sessions.collected_blocks(telemetry, NOW),
        "baseline_index": baseline.capture_index_usage(exported, "before", NOW),
        "baseline_frag": baseline.capture_fragmentation(exported, "before", NOW),
        "baseline_wait": baseline.capture_waits(exported, "before", NOW),
        "session_activity_log": sessions.activity_log_rows(telemetry, NOW),
    }
    for name, rows in written.items():
        assert types(rows.schema) == types(spark.createDataFrame([], TELEMETRY_SCHEMAS[name]).schema), name


def test_activity_log_written_and_read(spark, telemetry, tmp_path):
    for minute in (0, 5):
        append_by_date(sessions.activity_log_rows(telemetry, NOW.replace(minute=minute)), str(tmp_path / "session_activity_log"), "collection_time")
    latest = sessions.activity_log_latest(Telemetry.from_files(spark, str(tmp_path)), top=20).collect()
    servers = {r["server_id"] for r in latest}
    assert len(servers) > 1 and len(latest) > 20 and all(1 <= sum(r["server_id"] == s for r in latest) <= 20 for s in servers)
    assert {r["collection_time"].minute for r in latest if r["rank"] == 1} == {5}


def test_activity_options(telemetry):
    rows = sessions.activity(telemetry, show_sleeping=sessions.SHOW_SLEEPING)
    hidden = sessions.activity(telemetry, show_sleeping=sessions.HIDE_SLEEPING)
    default = sessions.activity(telemetry)
    assert rows.count() > default.count() > hidden.count()
    assert hidden.where("session_status = 'sleeping'").isEmpty()
    one = sessions.activity(telemetry, include=("login", "app_1"), sort_by="blocked_sessions", top=3)
    assert {r[0] for r in one.select("login_name").distinct().collect()} == {"app_1"}
    assert one.where("rank = 1 AND blocked_sessions = 0 AND server_id = 0").count() <= 4


def test_every_blocked_session_has_a_leader(telemetry):
    """Sessions in no cycle stand behind at least one leader: none is lost."""
    edges = blocking.blocking_edges(telemetry)
    cyclic = blocking.mutual_waits(telemetry, datetime(2020, 1, 1), datetime(2030, 1, 1))
    same = ["server_id", "snapshot_ts"]
    loose = edges.select(*same, "session_id").distinct().join(cyclic.select(*same, "session_id"), [*same, "session_id"], "left_anti")
    leaders = blocking.block_leaders(telemetry)
    assert leaders.agg(F.sum("blocked_sessions")).first()[0] >= loose.count()


class NamedFolder:
    """A session of a cluster that names its checkpoint folder."""

    def __init__(self, root: str | None, master: str = "yarn"):
        self.conf, self.sparkContext, self.used, self.master = self, self, None, master
        self.root = root

    def get(self, name: str, default=None):
        return self.root if name == "spark.checkpoint.dir" else default

    def getCheckpointDir(self):
        return self.used

    def setCheckpointDir(self, path: str):
        self.used = path


def test_checkpoints_use_the_folder_the_cluster_names():
    named = NamedFolder("hdfs://shared/checkpoints/")
    assert checkpoint_root(named) == named.used == "hdfs://shared/checkpoints/"
    assert work_path(named, "logs").startswith("hdfs://shared/checkpoints/logs-")
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        checkpoint_root(NamedFolder(None))
    own = NamedFolder(None, "local[4]")
    assert checkpoint_root(own) == checkpoint_root(own) == own.used


def test_tables_between_steps_are_dropped(spark):
    from fleetgauge.session import drop_work

    path = work_path(spark, "some")
    spark.range(3).write.parquet(path)
    assert spark.read.parquet(path).count() == 3 and drop_work(spark) >= 1
    assert not any(Path(path).exists() for path in [path]) and drop_work(spark) == 0


def test_forecast_counts_from_as_of(make):
    """Ten daily backups of 1000 to 1090 MB, 10 MB more each day; 2000 MB are reached 91 days after the last."""
    mb = 1024**2
    backups = [{"server_id": 1, "database_name": "d", "backup_set_id": k, "type": "D", "backup_finish_date": datetime(2024, 1, 1 + k, 5), "backup_size": (1000 + 10 * k) * mb} for k in range(10)]
    late = {"server_id": 1, "database_name": "d", "backup_set_id": 99, "type": "D", "backup_finish_date": datetime(2024, 3, 1), "backup_size": 90_000 * mb}
    days = lambda rows, as_of: history.growth_forecast(make(backupset=rows), as_of, 2000).first()["days_to_capacity"]
    assert days(backups, datetime(2024, 1, 10, 12)) == 91 and days(backups, datetime(2024, 1, 11)) == 90
    assert days(backups, datetime(2030, 1, 1)) == 0
    assert days([*backups, late], datetime(2024, 1, 11)) == 90  # a backup from after as_of does not count


@pytest.mark.parametrize("points", [12, 60])
def test_a_purge_in_the_middle_does_not_bend_the_forecast(make, points):
    """Ten MB more each day, a purge of 900 MB half way: the line through all backups falls, the one since the purge rises by ten."""
    mb = 1024**2
    sizes = [2000 + 10 * k - 900 * (k >= points // 2) for k in range(points)]
    start = datetime(2024, 1, 1, 5)
    backups = [{"server_id": 1, "database_name": "d", "backup_set_id": k, "type": "D", "backup_finish_date": start + timedelta(days=k), "backup_size": s * mb} for k, s in enumerate(sizes)]
    noisy = {**backups[-3], "database_name": "d", "backup_set_id": 500, "backup_size": sizes[-3] * mb + 60 * mb}  # one odd backup beside
    as_of = start + timedelta(days=points - 1)
    row = history.growth_after_shifts(make(backupset=[*backups, noisy]), as_of, 5000).first()
    assert (row["level_shifts"], row["backups"], row["mb_per_day"], row["mb_now"]) == (1, points - points // 2 + 1, 10.0, float(sizes[-1]))
    assert row["days_to_capacity"] == -(-(5000 - sizes[-1]) // 10)
    assert history.growth_forecast(make(backupset=backups), as_of, 5000).first()["mb_per_day"] < 5
    steady = history.growth_after_shifts(make(backupset=[{**b, "backup_size": (1000 + 10 * k) * mb} for k, b in enumerate(backups)]), as_of, 2000).first()
    assert (steady["level_shifts"], steady["mb_per_day"]) == (0, 10.0)
    one = history.growth_after_shifts(make(backupset=backups[:1]), as_of).first()
    assert (one["backups"], one["mb_per_day"], one["days_to_capacity"]) == (1, None, None)


COUNTERS = (
    "server_info query_stats proc_stats trigger_stats wait_snapshot missing_index_group missing_index_stats missing_index_detail "
    "index_physical index_usage stats_properties qs_options process_memory perf_counter server_config buffer_page file_io volume "
    "cached_plan log_vlf partition_rows"
).split()


@pytest.mark.parametrize("name", [
    "q01_uptime_confidence", "q04a_query_cpu", "q04b_proc_cpu", "q05_wait_ranking", "q08_missing_indexes", "q09a_fragmentation", "q10_unused_indexes",
    "q12a_trigger_cpu", "q13a_qs_capacity", "q16a_process_memory", "q16b_page_life", "q16c_memory_cap", "q16d_buffer_by_db", "q17a_file_latency",
    "q17b_volume_space", "q18_stale_stats", "q19a_cached_plans", "q19b_single_use_ratio", "q23a_config_audit", "q23c_server_uptime", "q24a_vlf_by_db",
    "q24b_vlf_size", "q29b_wait_actions", "q30a_stats_diagnosis", "q32a_availability", "q33_io_share", "q35_rows_per_table", "x05_cache_topk",
    "x07_index_review", "x08_maintenance_plan", "x17_safe_drop_gate", "x19_wait_playbook", "x20_updatestats_scope",
])
def test_two_exports_of_a_server_do_not_mix(telemetry, name):
    """Counters exported twice give the report twice, once for each snapshot."""
    stamps = [datetime(2024, 1, 30), datetime(2024, 1, 31)]
    twice = {
        t: telemetry[t].withColumn("snapshot_ts", F.explode(F.array(*[F.lit(s.isoformat(" ")).cast("timestamp") for s in stamps])))
        for t in COUNTERS
    }
    once, both = REPORTS[name](telemetry), REPORTS[name](telemetry.replaced(**twice))
    assert "snapshot_ts" in both.columns
    for s in stamps:
        one = both.where(F.col("snapshot_ts") == F.lit(s.isoformat(" ")).cast("timestamp")).select(*once.columns)
        assert one.exceptAll(once).isEmpty() and once.exceptAll(one).isEmpty()


CAPTURED = ("wait_snapshot_earlier", "index_usage_earlier", "index_physical_earlier", "index_operational", "index_operational_earlier")


@pytest.mark.parametrize("name", [
    "q04c_wait_capture", "q04d_wait_delta", "q28a_capture_index_usage", "q28b_capture_fragmentation", "q28c_capture_waits", "q28d_capture_after",
    "q28e_index_usage_delta", "q28f_fragmentation_delta", "q28g_wait_change",
])
def test_two_exports_of_captures_and_readings_do_not_mix(telemetry, name):
    """Captures and readings exported twice give exactly twice the rows, each of its own snapshot."""
    stamps = [datetime(2024, 1, 30), datetime(2024, 1, 31)]
    times = F.array(*[F.lit(s.isoformat(" ")).cast("timestamp") for s in stamps])
    twice = {t: telemetry[t].withColumn("snapshot_ts", F.explode(times)) for t in (*COUNTERS, *CAPTURED)}
    once, both = REPORTS[name](telemetry), REPORTS[name](telemetry.replaced(**twice))
    assert both.count() == 2 * once.count() > 0
    for s in stamps:
        one = both.where(F.col("snapshot_ts") == F.lit(s.isoformat(" ")).cast("timestamp")).select(*once.columns)
        assert one.exceptAll(once).isEmpty() and once.exceptAll(one).isEmpty()


def test_stored_captures_of_several_days_meet_their_readings(spark, telemetry, tmp_path):
    """Two captures and three readings stored as they come: each reading meets the latest capture before it."""
    path = str(tmp_path / "baseline_wait")
    often = exported_often(telemetry)
    for _ in range(2):  # storing again replaces
        save_phase(baseline.capture_waits(often, "before", NOW, waits="wait_snapshot_earlier"), path)
        save_phase(baseline.capture_waits(often, "7d", NOW), path)
    stored = spark.read.schema(TELEMETRY_SCHEMAS["baseline_wait"] + ", captured_on date").parquet(path)
    got, want = baseline.wait_change(stored), REPORTS["q28j_wait_change_exports"](telemetry)
    assert want.count() > 0 and got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


def test_declared_counters_carry_their_snapshot():
    assert all("snapshot_ts timestamp" in TELEMETRY_SCHEMAS[t] for t in [*COUNTERS, "index_operational", "temp_file_space"])


def test_error_log_reader(spark, tmp_path):
    from fleetgauge.sources.error_log import read_error_log

    folder = tmp_path / "server_id=7" / "log_id=1"
    folder.mkdir(parents=True)
    (folder / "a.txt").write_text("2024-01-30 01:02:03.45 Server   SQL Server is starting at normal priority\n  more of it\n2024-01-30 01:02:09.00 spid9s   it is now ready for connections\n")
    rows = history.restart_events(Telemetry.from_frames(spark, error_log=read_error_log(spark, str(tmp_path)))).collect()
    assert sorted((r["server_id"], r["event_ts"].second, r["log_type"], r["phrase"]) for r in rows) == [(7, 3, "Server", "is starting"), (7, 9, "spid9s", "is now ready")]


def test_logs_with_date_partitions_are_pruned_by_the_report(spark, telemetry, tmp_path):
    append_by_date(telemetry["log_session"], str(tmp_path / "log_session"), "snapshot_ts")
    landed = telemetry.replaced(log_session=spark.read.parquet(str(tmp_path / "log_session")))
    report = history.hourly_sessions(landed, NOW)
    assert "PartitionFilters: [isnotnull(dt" in report._jdf.queryExecution().executedPlan().toString()
    assert report.exceptAll(history.hourly_sessions(telemetry, NOW)).isEmpty()
