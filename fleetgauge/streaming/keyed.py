"""Counter deltas with keyed state: the last reading of each counter, in Spark's state store."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from fleetgauge.streaming.live import COUNTER, trigger_of

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
LAST = "snapshot_us bigint, wait_time_ms bigint"
DELTAS = (
    "server_id bigint, wait_type string, prev_snapshot_us bigint, snapshot_us bigint, wait_time_ms bigint, "
    "delta_ms bigint, was_reset int, is_late boolean"
)


class CounterDeltas(StatefulProcessor):
    """State of one counter: its last reading. It goes when the counter has been silent for `ttl_ms`."""

    def __init__(self, ttl_ms: int | None):
        self._ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._last = handle.getValueState("last", LAST, self._ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        # the readings of one counter in one batch: as many as it was sampled
        batch = pd.concat(rows).sort_values("snapshot_us", kind="stable")
        last, out = self._last.get(), []
        for at, value in zip(batch["snapshot_us"].tolist(), batch["wait_time_ms"].tolist()):
            if last is not None and at <= last[0]:  # too late for a delta
                out.append((last[0], at, value, None, None, True))
                continue
            if last is not None:
                out.append((last[0], at, value, value - last[1] if value >= last[1] else value, int(value < last[1]), False))
            last = (at, value)
        if last is not None:
            self._last.update(tuple(last))
        if out:
            before, at, value, delta, reset, late = zip(*out)
            yield pd.DataFrame({
                "server_id": key[0], "wait_type": key[1], "prev_snapshot_us": pd.Series(before, dtype="Int64"),
                "snapshot_us": pd.Series(at, dtype="Int64"), "wait_time_ms": pd.Series(value, dtype="Int64"),
                "delta_ms": pd.Series(delta, dtype="Int64"), "was_reset": pd.Series(reset, dtype="Int32"), "is_late": list(late),
            })

    def close(self) -> None:
        pass


def counter_deltas(readings: DataFrame, ttl_ms: int | None = None) -> DataFrame:
    """Change of every counter since the reading before it, with resets after restarts; late readings are marked.

    Only the counters of a batch are read and written in the state store. Readings of one
    counter in one batch are sorted in memory.
    """
    micros = readings.select(*COUNTER, F.unix_micros("snapshot_ts").alias("snapshot_us"), "wait_time_ms")
    found = micros.groupBy(*COUNTER).transformWithStateInPandas(CounterDeltas(ttl_ms), DELTAS, "Append", "ProcessingTime" if ttl_ms else "None")
    return found.select(
        *COUNTER, F.timestamp_micros("prev_snapshot_us").alias("prev_snapshot_ts"), F.timestamp_micros("snapshot_us").alias("snapshot_ts"),
        "wait_time_ms", "delta_ms", "was_reset", "is_late",
    )


def start_counter_deltas(
    readings: DataFrame, out: str, checkpoint: str, every: str | None = None, ttl_ms: int | None = None
) -> StreamingQuery:
    """Write the deltas and the late readings, apart, each row once: the sink's log knows the batches that are through."""
    spark: SparkSession = readings.sparkSession
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKSDB)  # what such state needs; a query keeps it from its start on
    try:
        return (
            counter_deltas(readings, ttl_ms).writeStream.format("parquet").outputMode("append").partitionBy("is_late")
            .option("path", out).option("checkpointLocation", checkpoint).trigger(**trigger_of(every)).start()
        )
    finally:
        spark.conf.set(PROVIDER, before)
