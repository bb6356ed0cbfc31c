"""Streaming reports: hourly history, counter deltas, alerts, late rows."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from fleetgauge.functions.numbers import count_where, idiv
from fleetgauge.functions.severity import ATTENTION, CRITICAL, grade
from fleetgauge.functions.timeunits import instant
from fleetgauge.operators.previous import counter_delta, with_previous
from fleetgauge.plans.history import hourly_ladder


def trigger_of(every: str | None) -> dict:
    """Run at an interval ("5 minutes"), or once over what has landed."""
    return {"processingTime": every} if every else {"availableNow": True}


def write_stream(
    rows: DataFrame, out: str, checkpoint: str, mode: str = "append", every: str | None = None
) -> StreamingQuery:
    """Write a streaming report to parquet; the checkpoint resumes it later."""
    return (
        rows.writeStream.format("parquet")
        .outputMode(mode)
        .option("path", out)
        .option("checkpointLocation", checkpoint)
        .trigger(**trigger_of(every))
        .start()
    )


def hourly_sessions(log: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Hourly history of a session-log stream, final once the watermark passes the hour.

    Streams refuse exact distinct counts, so sessions are first aggregated one by one
    within the hour and then counted: two chained windowed aggregations.
    """
    per_session = (
        log.withWatermark("snapshot_ts", delay)
        .groupBy(F.window("snapshot_ts", "1 hour").alias("hour"), "server_id", "session_id")
        .agg(F.max("cpu_time").alias("cpu"), count_where(F.col("blocking_session_id") > 0).alias("hits"))
    )
    return (
        per_session.groupBy(F.window("hour", "1 hour").alias("hour"), "server_id")
        .agg(
            F.count("*").alias("sessions"), F.max("cpu").alias("max_cpu_ms"), F.sum("hits").alias("blocked")
        )
        .select("server_id", F.col("hour.start").alias("hour_start"), "sessions", "max_cpu_ms", "blocked")
        .withColumns(hourly_ladder())
    )


COUNTER = ("server_id", "wait_type")
READING = ("snapshot_ts", "wait_time_ms")


def delta_batch(batch: DataFrame, last: DataFrame | None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(deltas, newest readings, late readings) of a micro-batch after the ``last`` known readings.

    A reading that is not newer than the last one of its counter comes too late for a
    delta; it is set aside with the time it came after. Deltas come from with_previous,
    so a counter with very many rows in one batch is spread over its hours.
    """
    rows = batch.select(*COUNTER, *READING).withColumn("is_new", F.lit(True))
    known = rows.withColumn("known_ts", F.lit(None).cast("timestamp"))
    if last is not None:
        known = rows.join(last.select(*COUNTER, F.col("snapshot_ts").alias("known_ts")), list(COUNTER), "left")
    late = known.where(F.col("snapshot_ts") <= F.col("known_ts")).drop("is_new")
    if last is not None:
        rows = known.where(F.col("known_ts").isNull() | (F.col("snapshot_ts") > F.col("known_ts"))).drop("known_ts")
        rows = rows.unionByName(last.select(*COUNTER, *READING).withColumn("is_new", F.lit(False)))
    chained = with_previous(rows, COUNTER, ["snapshot_ts"], F.date_trunc("hour", "snapshot_ts"), READING)
    deltas = chained.where(F.col("is_new") & F.col("prev_snapshot_ts").isNotNull()).select(
        *COUNTER, "prev_snapshot_ts", "snapshot_ts",
        counter_delta("wait_time_ms", "prev_wait_time_ms").alias("delta_ms"),
        (F.col("wait_time_ms") < F.col("prev_wait_time_ms")).cast("int").alias("was_reset"),
    )
    newest = rows.groupBy(*COUNTER).agg(
        F.max("snapshot_ts").alias("snapshot_ts"), F.max_by("wait_time_ms", "snapshot_ts").alias("wait_time_ms")
    )
    return deltas, newest, late


def start_counter_deltas(
    readings: DataFrame, out: str, state: str, checkpoint: str, every: str | None = None
) -> StreamingQuery:
    """Change of every cumulative counter between readings, with resets after restarts.

    The state is a table with one row per counter, written anew by every batch (a
    collection reads all counters, so all rows change anyway) into one of two slots in
    turn. A batch that is replayed still finds the state before it in the other slot
    and overwrites its own output. Readings that come too late for a delta are kept
    beside the output, under ``<out>-late``, by batch.
    """

    def each(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        last = spark.read.parquet(f"{state}/slot={(batch_id - 1) % 2}") if batch_id > 0 else None
        batch = batch.persist()
        try:
            deltas, newest, late = delta_batch(batch, last)
            late.write.mode("overwrite").parquet(f"{out}-late/batch_id={batch_id}")
            deltas.write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")
            newest.write.mode("overwrite").parquet(f"{state}/slot={batch_id % 2}")
        finally:
            batch.unpersist()

    return (
        readings.writeStream.foreachBatch(each)
        .option("checkpointLocation", checkpoint)
        .trigger(**trigger_of(every))
        .start()
    )


def request_alerts(requests: DataFrame, databases: DataFrame) -> DataFrame:
    """Requests of a stream that deserve attention, named from a static dimension."""
    names = databases.select("server_id", "database_id", F.col("name").alias("database_name"))
    graded = requests.select(
        "server_id", "snapshot_ts", "session_id", "blocking_session_id", "cpu_time", "database_id",
        idiv("total_elapsed_time", 1000).alias("elapsed_seconds"),
        idiv("wait_time", 1000).alias("wait_seconds"),
    ).withColumns(
        grade(
            ((F.col("blocking_session_id") > 0) & (F.col("wait_seconds") > 60), CRITICAL, "blocked_over_60s"),
            ((F.col("blocking_session_id") > 0) & (F.col("wait_seconds") > 10), ATTENTION, "blocked_over_10s"),
            (F.col("cpu_time") > 60000, ATTENTION, "high_cpu"),
            (F.col("elapsed_seconds") > 300, ATTENTION, "long_running"),
        )
    )
    return graded.where(F.col("severity") != "OK").join(names, ["server_id", "database_id"], "left")


def start_late_counter(
    stream: DataFrame, event_time: str, delay: timedelta, out: str, checkpoint: str, every: str | None = None
) -> StreamingQuery:
    """Count, per micro-batch, the rows a watermark with this delay would drop.

    The row of the batch before is the state. Rows are kept under their batch number,
    so a replayed batch overwrites its own.
    """

    def each(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        earlier = F.lit(None).cast("timestamp")
        if batch_id > 0:  # the row before holds the latest time so far
            before = spark.read.parquet(f"{out}/batch_id={batch_id - 1}")
            earlier = instant(before.select(F.unix_micros("latest")).first()[0])
        time = F.col(event_time).cast("timestamp")
        border = earlier - F.make_dt_interval(secs=F.lit(delay.total_seconds()).cast("decimal(18,6)"))
        batch.agg(
            F.lit(batch_id).cast("long").alias("batch"), F.count("*").alias("rows"),
            count_where(time < border).alias("late_rows"),
            F.greatest(F.max(time), earlier).alias("latest"),
        ).write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    return (
        stream.writeStream.foreachBatch(each)
        .option("checkpointLocation", checkpoint)
        .trigger(**trigger_of(every))
        .start()
    )
