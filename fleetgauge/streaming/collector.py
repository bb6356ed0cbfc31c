"""The collector: micro-batches of landed telemetry appended to three log tables."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from fleetgauge.plans.sessions import collected_blocks, collected_sessions
from fleetgauge.plans.waiting import collected_waits
from fleetgauge.sources.compaction import read_compacted
from fleetgauge.sources.sinks import write_batch
from fleetgauge.sources.telemetry import Telemetry
from fleetgauge.streaming.live import trigger_of

LOGS = ("log_session", "log_wait", "log_block")


def collect_batch(t: Telemetry, collected_at: datetime | int, batch_id: int, root: str) -> None:
    """Append one snapshot to the three logs; all rows carry the same collection time.

    Each log is partitioned by date and batch, and a batch overwrites only its own
    partition: a batch that is run again after a failure leaves no duplicates.
    """
    logs = {
        "log_session": collected_sessions(t, collected_at),
        "log_wait": collected_waits(t, collected_at),
        "log_block": collected_blocks(t, collected_at),
    }
    for name, rows in logs.items():
        write_batch(rows, f"{root}/{name}", "collected_at", batch_id)


def start_collector(
    stream: DataFrame, telemetry_of: Callable[[DataFrame], Telemetry], event_time: str,
    root: str, checkpoint: str, every: str | None = None,
) -> StreamingQuery:
    """Collect a stream, ``every`` few minutes or once. ``telemetry_of`` turns a micro-batch into telemetry tables.

    The collection time is the latest event time of the batch: the same when a batch
    is replayed. The batch is kept while its three logs are written.
    """

    def each(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        try:
            latest = batch.agg(F.unix_micros(F.max(F.col(event_time).cast("timestamp")))).first()[0]
            if latest is not None:
                collect_batch(telemetry_of(batch), latest, batch_id, root)
        finally:
            batch.unpersist()

    return (
        stream.writeStream.foreachBatch(each)
        .option("checkpointLocation", checkpoint)
        .trigger(**trigger_of(every))
        .start()
    )


def read_log(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A collector log, compacted or not."""
    return read_compacted(spark, f"{root}/{name}")
