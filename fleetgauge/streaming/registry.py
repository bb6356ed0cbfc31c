"""The streaming reports as registered queries: they run over the test files once."""

from __future__ import annotations

from collections.abc import Callable
from datetime import timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from fleetgauge.session import prepare, work_path
from fleetgauge.sources.base_tables import BASE_SCHEMAS, read_base
from fleetgauge.sources.derived import DERIVED
from fleetgauge.sources.sinks import save_bucketed
from fleetgauge.sources.telemetry import Telemetry
from fleetgauge.streaming import keyed, live
from fleetgauge.streaming.collector import read_log, start_collector


SLICES = 4


def land(rows: DataFrame, slice_number: Column, name: str) -> list[str]:
    """Write rows once, by slice, and return what a source sees as the slices land one after the other."""
    landing = work_path(rows.sparkSession, name)
    rows.withColumn("_slice", slice_number.cast("int")).write.partitionBy("_slice").parquet(landing)
    return [f"{landing}/_slice={{{','.join(map(str, range(k + 1)))}}}" for k in range(SLICES)]


def by_time(rows: DataFrame, time: str) -> Column:
    """Slices of equal length between the first and the last time."""
    ends = rows.agg(F.unix_micros(F.min(F.col(time).cast("timestamp"))).alias("a"), F.unix_micros(F.max(F.col(time).cast("timestamp"))).alias("b")).first()
    first, length = ends["a"] or 0, max(1, (ends["b"] or 0) - (ends["a"] or 0) + 1)
    return F.floor((F.unix_micros(F.col(time).cast("timestamp")) - first) * SLICES / length)


def each_landing(spark: SparkSession, schema, paths: list[str], start: Callable[[DataFrame], StreamingQuery]) -> None:
    """Start the query anew for every landing, on the same checkpoint: a restart at every border."""
    for path in paths:
        start(spark.readStream.schema(schema).parquet(path)).awaitTermination()


def _landed_events(spark: SparkSession, folder: str, name: str) -> list[str]:
    events = read_base(spark, folder, "events")
    return land(events, by_time(events, "ts"), name)


def _texts_by_handle(t: Telemetry) -> str:
    """A table of the statement texts, bucketed by handle: shuffled once, and no more by the batches that look texts up."""
    path, buckets = work_path(t.spark, "collector-texts"), int(t.spark.conf.get("spark.sql.shuffle.partitions"))
    table = f"collector_texts_{path[-32:]}"
    save_bucketed(t["sql_text"].repartition(buckets, "sql_handle"), table, ["sql_handle"], buckets, path)
    return table


def collect(spark: SparkSession, folder: str) -> DataFrame:
    """All three collector logs, by their key and main measure; events land in slices of time, a batch each."""
    root, state = work_path(prepare(spark), "collector"), work_path(spark, "collector-state")
    texts = _texts_by_handle(Telemetry.derived(spark, folder))

    def telemetry_of(batch: DataFrame) -> Telemetry:
        session = batch.sparkSession
        return Telemetry.derived(session, folder, events=batch).replaced(sql_text=session.table(texts))

    paths = _landed_events(spark, folder, "collector-landing")
    try:
        each_landing(spark, BASE_SCHEMAS["events"], paths, lambda events: start_collector(events, telemetry_of, "ts", root, state))
    finally:
        spark.sql(f"DROP TABLE {texts}")
    logs = {
        "session": ("log_session", "session_id", "cpu_time"),
        "wait": ("log_wait", "rank", "wait_time_ms"),
        "block": ("log_block", "blocked_session_id", "wait_seconds"),
    }
    parts = [
        read_log(spark, root, table).select(
            F.lit(log).alias("log"), "server_id", "collected_at", "wait_type",
            F.col(key).cast("bigint").alias("item"), F.col(measure).alias("measure"),
        )
        for log, (table, key, measure) in logs.items()
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def _run(spark: SparkSession, folder: str, name: str, report: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """A streaming report over events that land in slices of time, written and read back."""
    out, state = work_path(spark, name), work_path(spark, f"{name}-state")
    paths = _landed_events(spark, folder, f"{name}-landing")
    each_landing(spark, BASE_SCHEMAS["events"], paths, lambda events: live.write_stream(report(events), out, state))
    return spark.read.parquet(out)


def hourly(spark: SparkSession, folder: str) -> DataFrame:
    """Hours of the session log. The last batch only moves the watermark, as the next landing would."""
    return _run(prepare(spark), folder, "hourly", lambda events: live.hourly_sessions(spark.sql(DERIVED["log_session"], events=events)))


def counter_delta(spark: SparkSession, folder: str) -> DataFrame:
    """Readings that land in slices of time: deltas cross batches and restarts."""
    series = Telemetry.derived(prepare(spark), folder)["wait_series"]
    out, state, check = work_path(spark, "deltas"), work_path(spark, "deltas-last"), work_path(spark, "deltas-state")
    paths = land(series, by_time(series, "snapshot_ts"), "readings")
    each_landing(spark, series.schema, paths, lambda readings: live.start_counter_deltas(readings, out, state, check))
    return spark.read.parquet(out).drop("batch_id")


def keyed_delta(spark: SparkSession, folder: str) -> DataFrame:
    """The same from Spark's own keyed state; late readings are written apart."""
    series = Telemetry.derived(prepare(spark), folder)["wait_series"]
    out, check = work_path(spark, "keyed-deltas"), work_path(spark, "keyed-deltas-state")
    paths = land(series, by_time(series, "snapshot_ts"), "keyed-readings")
    each_landing(spark, series.schema, paths, lambda readings: keyed.start_counter_deltas(readings, out, check))
    return spark.read.parquet(out).where("NOT is_late").select("server_id", "wait_type", "prev_snapshot_ts", "snapshot_ts", "delta_ms", "was_reset")


def alerts(spark: SparkSession, folder: str) -> DataFrame:
    databases = Telemetry.derived(prepare(spark), folder)["database_dim"]
    return _run(
        spark, folder, "alerts",
        lambda events: live.request_alerts(spark.sql(DERIVED["request_snapshot"], events=events), databases),
    )


def late(spark: SparkSession, folder: str) -> DataFrame:
    """All events, landed in four slices that overlap in time, one batch each."""
    events = read_base(prepare(spark), folder, "events")
    out, state = work_path(spark, "late"), work_path(spark, "late-state")
    paths = land(events, F.col("user_id") % SLICES, "landing")
    each_landing(
        spark, BASE_SCHEMAS["events"], paths,
        lambda stream: live.start_late_counter(stream, "ts", timedelta(hours=1), out, state),
    )
    return spark.read.parquet(f"{out}/batch_id=*").select("batch", "rows", "late_rows", "latest")


STREAMS: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "st1_collect": collect,
    "st2_hourly": hourly,
    "st3_counter_delta": counter_delta,
    "st3b_keyed_delta": keyed_delta,
    "st4_alerts": alerts,
    "st5_late": late,
}
