from __future__ import annotations

from datetime import datetime, timedelta

import pytest
from report_helpers import SMALL
from pyspark.sql import functions as F

from fleetgauge.plans import sessions, waiting
from fleetgauge.sources.base_tables import BASE_SCHEMAS, read_base
from fleetgauge.sources.telemetry import Telemetry
from fleetgauge.streaming import keyed, live
from fleetgauge.streaming.collector import collect_batch, read_log, start_collector


@pytest.fixture()
def landed(spark, tmp_path):
    """Events landed server by server, in five files that are read one per batch."""
    events = read_base(spark, SMALL, "events")
    for part in range(5):
        rows = events.where((F.col("event_id") >= part * 200) & (F.col("event_id") < (part + 1) * 200))
        rows.coalesce(1).write.parquet(str(tmp_path / "landing" / f"part={part}"))
    return (
        spark.readStream.schema(BASE_SCHEMAS["events"]).option("maxFilesPerTrigger", 1)
        .parquet(str(tmp_path / "landing" / "part=*"))
    )


def test_collector_over_batches_equals_one_report(spark, landed, telemetry, tmp_path):
    root = str(tmp_path / "logs")
    query = start_collector(
        landed, lambda batch: Telemetry.derived(batch.sparkSession, SMALL, events=batch), "ts", root, str(tmp_path / "state")
    )
    query.awaitTermination()
    log = read_log(spark, root, "log_session")
    assert log.select("batch_id").distinct().count() == 5
    # every server's requests came in one batch, so the union of batches is the whole
    whole = sessions.collected_sessions(telemetry, datetime(2024, 1, 31)).drop("collected_at")
    assert log.select(whole.columns).exceptAll(whole).isEmpty() and log.count() == whole.count()
    blocks = read_log(spark, root, "log_block")
    assert blocks.count() == sessions.collected_blocks(telemetry, datetime(2024, 1, 31)).count()
    # one collection time per batch, shared by the three logs
    stamps = {r[0]: r[1] for r in log.select("batch_id", "collected_at").distinct().collect()}
    waits = {r[0]: r[1] for r in read_log(spark, root, "log_wait").select("batch_id", "collected_at").distinct().collect()}
    assert stamps == waits and len(stamps) == 5


def test_a_replayed_batch_leaves_no_duplicates(spark, telemetry, tmp_path):
    root = str(tmp_path)
    for _ in range(2):
        collect_batch(telemetry, datetime(2024, 1, 31), 3, root)
    once = waiting.collected_waits(telemetry, datetime(2024, 1, 31)).count()
    assert read_log(spark, root, "log_wait").count() == once


def reading(ts, ms, wait="A"):
    return (1, wait, ts, ms)


def test_counter_deltas_over_batches(spark, tmp_path):
    schema = "server_id long, wait_type string, snapshot_ts timestamp, wait_time_ms long"
    start = datetime(2024, 1, 1)
    hour = [start + timedelta(hours=h) for h in range(8)]
    batches = [
        [reading(hour[0], 10), reading(hour[1], 30), reading(hour[0], 5, "B")],
        [reading(hour[2], 25)],  # a reset: 25 since the restart
        [reading(hour[1], 99), reading(hour[4], 26), reading(hour[3], 26), reading(hour[5], 9, "B")],  # 99 comes too late
    ]
    landing = tmp_path / "landing"
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(landing / f"n={n}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(landing / "n=*"))
    out = str(tmp_path / "out")
    live.start_counter_deltas(stream, out, str(tmp_path / "state"), str(tmp_path / "check")).awaitTermination()
    got = sorted((r["wait_type"], r["snapshot_ts"], r["delta_ms"], r["was_reset"]) for r in spark.read.parquet(out).collect())
    late = [(r["wait_type"], r["wait_time_ms"], r["known_ts"]) for r in spark.read.parquet(f"{out}-late").collect()]
    assert late == [("A", 99, hour[2])]
    assert got == [("A", hour[1], 20, 0), ("A", hour[2], 25, 1), ("A", hour[3], 1, 0), ("A", hour[4], 0, 0), ("B", hour[5], 4, 0)]


def test_late_rows_are_counted(spark, tmp_path):
    base = datetime(2024, 1, 1)
    files = [[0, 300], [299, 10, 230, 241], [500]]  # minutes
    for n, minutes in enumerate(files):
        rows = [(base + timedelta(minutes=m),) for m in minutes]
        spark.createDataFrame(rows, "ts timestamp").coalesce(1).write.parquet(str(tmp_path / "in" / f"n={n}"))
    stream = spark.readStream.schema("ts timestamp").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "n=*"))
    out = str(tmp_path / "out")
    live.start_late_counter(stream, "ts", timedelta(hours=1), out, str(tmp_path / "check")).awaitTermination()
    got = [(r["rows"], r["late_rows"]) for r in spark.read.parquet(f"{out}/batch_id=*").orderBy("batch").collect()]
    assert got == [(2, 0), (4, 2), (1, 0)]


def test_hourly_stream_equals_batch(spark, landed, tmp_path):
    from fleetgauge.sources.derived import DERIVED

    log = spark.sql(DERIVED["log_session"], events=landed)
    out = str(tmp_path / "hours")
    live.write_stream(live.hourly_sessions(log), out, str(tmp_path / "check")).awaitTermination()
    got = spark.read.parquet(out)
    rows = spark.sql(DERIVED["log_session"], events=read_base(spark, SMALL, "events"))
    want = rows.groupBy("server_id", F.date_trunc("hour", "snapshot_ts").alias("hour_start")).agg(F.countDistinct("session_id").alias("sessions"))
    final = rows.agg(F.max("snapshot_ts")).first()[0] - timedelta(minutes=10)
    want = want.where(F.col("hour_start") + F.expr("INTERVAL 1 HOUR") <= F.lit(str(final)).cast("timestamp"))
    assert got.select(want.columns).exceptAll(want).isEmpty() and got.count() == want.count()


ELSEWHERE = """
import sys, time, tempfile
sys.path.insert(0, {repo!r})
from datetime import timedelta
from fleetgauge.session import local_session, prepare
from fleetgauge.streaming import live
spark = prepare(local_session(2))
base = tempfile.mkdtemp()
for n, minutes in enumerate([[0, 300], [299, 10, 230, 241], [500]]):
    spark.sql("SELECT timestamp_micros(1706600000000000 + m * 60000000L) AS ts FROM VALUES " + ",".join(f"({{m}})" for m in minutes) + " v(m)").coalesce(1).write.parquet(f"{{base}}/in/n={{n}}")
stream = spark.readStream.schema("ts timestamp").option("maxFilesPerTrigger", 1).parquet(f"{{base}}/in/n=*")
live.start_late_counter(stream, "ts", timedelta(hours=1), f"{{base}}/out", f"{{base}}/check").awaitTermination()
rows = spark.read.parquet(f"{{base}}/out/batch_id=*").selectExpr("batch", "late_rows", "(unix_micros(latest) - 1706600000000000) div 60000000").orderBy("batch").collect()
print("ROWS", [tuple(r) for r in rows])
"""


def test_the_drivers_time_zone_does_not_matter():
    import os
    import subprocess
    import sys
    from pathlib import Path

    code = ELSEWHERE.format(repo=str(Path(__file__).resolve().parents[1]))
    out = subprocess.run([sys.executable, "-c", code], env=os.environ | {"TZ": "Asia/Tokyo"}, capture_output=True, text=True, timeout=300).stdout
    assert "ROWS [(0, 0, 300), (1, 2, 300), (2, 0, 500)]" in out


READINGS = "server_id bigint, wait_type string, snapshot_ts timestamp, wait_time_ms bigint"


def land_readings(spark, path, rows):
    made = [(s, w, datetime(2024, 1, 1, h), v) for s, w, h, v in rows]
    spark.createDataFrame(made, READINGS).repartition(2).write.mode("append").parquet(path)


def keyed_run(spark, tmp_path):
    query = keyed.start_counter_deltas(spark.readStream.schema(READINGS).parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "check"))
    query.awaitTermination()
    return query


def keyed_rows(spark, tmp_path):
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    return sorted((r["server_id"], r["wait_type"], r["prev_snapshot_ts"].hour, r["snapshot_ts"].hour, r["delta_ms"], r["was_reset"], r["is_late"] == "true") for r in rows)


def test_keyed_state_over_restarts_and_replays(spark, tmp_path):
    """Deltas cross restarts; only the counters of a batch are written; a batch that runs again leaves no row twice."""
    land_readings(spark, str(tmp_path / "in"), [(k, "A", 1, 100 * k) for k in range(1, 21)] + [(1, "A", 2, 150)])
    first = keyed_run(spark, tmp_path)
    assert keyed_rows(spark, tmp_path) == [(1, "A", 1, 2, 50, 0, False)]
    land_readings(spark, str(tmp_path / "in"), [(1, "A", 3, 20), (1, "A", 2, 160), (2, "A", 4, 260), (2, "A", 3, 250), (30, "B", 3, 1)])
    second = keyed_run(spark, tmp_path)
    want = [(1, "A", 1, 2, 50, 0, False), (1, "A", 2, 2, None, None, True), (1, "A", 2, 3, 20, 1, False), (2, "A", 1, 3, 50, 0, False), (2, "A", 3, 4, 10, 0, False)]
    assert keyed_rows(spark, tmp_path) == want
    states = [[p["stateOperators"][0] for p in q.recentProgress if p["numInputRows"]][-1] for q in (first, second)]
    assert [s["numRowsUpdated"] for s in states] == [20, 3] and states[1]["numRowsTotal"] == 21
    keyed_run(spark, tmp_path)  # nothing has landed
    assert keyed_rows(spark, tmp_path) == want
    commits = sorted((int(p.name) for p in (tmp_path / "check" / "commits").iterdir() if p.name.isdigit()))
    for p in (tmp_path / "check" / "commits").glob(f"*{commits[-1]}*"):
        p.unlink()  # as if the query had died before its last batch was through
    keyed_run(spark, tmp_path)
    assert keyed_rows(spark, tmp_path) == want


def test_keyed_state_leaves_the_session_as_it_was(spark, tmp_path):
    before = spark.conf.get(keyed.PROVIDER)
    land_readings(spark, str(tmp_path / "in"), [(1, "A", 1, 5)])
    keyed_run(spark, tmp_path)
    assert spark.conf.get(keyed.PROVIDER) == before
