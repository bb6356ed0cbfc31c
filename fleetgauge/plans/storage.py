"""Files, volumes, logs: latency, space, growth settings, I/O shares."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetgauge.functions.numbers import count_where, idiv, pages_to_mb, percent, ratio
from fleetgauge.functions.severity import ATTENTION, CRITICAL, OK, grade
from fleetgauge.plans.lookups import with_database
from fleetgauge.sources.telemetry import Telemetry, snapshot_keys

DATA_FILE, LOG_FILE = 0, 1
BYTES_PER_GB = 1024**3


def file_latency(t: Telemetry) -> DataFrame:
    """Average latency per file. The ladder compares whole milliseconds, reads before writes."""
    io = t["file_io"]
    files = t["file_dim"].select("server_id", "database_id", "file_id", "file_name", "type")
    reads, writes = F.col("num_of_reads"), F.col("num_of_writes")
    read_ms, write_ms = idiv("io_stall_read_ms", "num_of_reads"), idiv("io_stall_write_ms", "num_of_writes")
    rows = io.join(files, ["server_id", "database_id", "file_id"])
    return (
        rows.withColumns(
            grade(
                ((reads > 0) & (read_ms > 50), CRITICAL, "read_over_50ms"),
                ((reads > 0) & (read_ms > 20), ATTENTION, "read_over_20ms"),
                ((writes > 0) & (write_ms > 50), CRITICAL, "write_over_50ms"),
                ((writes > 0) & (write_ms > 20), ATTENTION, "write_over_20ms"),
            )
        )
        .withColumns(
            {
                "avg_read_ms": F.coalesce(ratio("io_stall_read_ms", "num_of_reads", 10, 2), F.lit(0)),
                "avg_write_ms": F.coalesce(ratio("io_stall_write_ms", "num_of_writes", 10, 2), F.lit(0)),
                "read_mb": ratio("num_of_bytes_read", F.lit(1048576), 12, 1),
                "written_mb": ratio("num_of_bytes_written", F.lit(1048576), 12, 1),
            }
        )
        .select(
            *snapshot_keys(io), "database_id", "file_id", "file_name", "type", "avg_read_ms", "avg_write_ms",
            "num_of_reads", "num_of_writes", "read_mb", "written_mb", "severity", "reason",
        )
    )


def volume_space(t: Telemetry) -> DataFrame:
    """Free space of the volumes that hold files; one row per volume."""
    used = t["file_dim"].select("server_id", "volume_id").distinct()
    total, free = F.col("total_bytes"), F.col("available_bytes")
    volumes = t["volume"]
    keys = snapshot_keys(volumes)
    return (
        volumes.join(used, ["server_id", "volume_id"], "left_semi")
        .select(*keys, "mount_point", "total_bytes", "available_bytes")
        .distinct()
        .withColumns(
            grade(
                (free * 100 < total * 5, CRITICAL, "under_5_pct"),
                (free * 100 < total * 10, CRITICAL, "under_10_pct"),
                (free * 100 < total * 20, ATTENTION, "under_20_pct"),
            )
        )
        .select(
            *keys, "mount_point", idiv("total_bytes", BYTES_PER_GB).alias("total_gb"),
            idiv("available_bytes", BYTES_PER_GB).alias("free_gb"),
            percent("available_bytes", "total_bytes").alias("free_pct"), "severity", "reason",
        )
    )


def log_reuse(t: Telemetry) -> DataFrame:
    wait = F.col("log_reuse_wait")
    return (
        t["database_dim"]
        .where(F.col("state_desc") == "ONLINE")
        .select("server_id", "name", "recovery_model", "log_reuse_wait")
        .withColumns(
            grade(
                (wait == "LOG_BACKUP", ATTENTION, "log_backup_pending"),
                (wait == "ACTIVE_TRANSACTION", ATTENTION, "long_transaction"),
                (wait == "NOTHING", OK, "ok"),
                otherwise=("VERIFY", "other"),
            )
        )
    )


def log_versus_data(t: Telemetry) -> DataFrame:
    """Log size against data size. Sizes truncate per file; the ladder compares pages."""
    online = t["database_dim"].where(F.col("state_desc") == "ONLINE").select("server_id", "database_id", "name")
    size, kind = F.col("size_pages"), F.col("type")

    def total(value, which):
        return F.sum(F.when(kind == which, value).otherwise(0))

    return (
        t["file_dim"]
        .groupBy("server_id", "database_id")
        .agg(
            total(pages_to_mb(size), DATA_FILE).alias("data_mb"),
            total(pages_to_mb(size), LOG_FILE).alias("log_mb"),
            total(size, DATA_FILE).alias("data_pages"),
            total(size, LOG_FILE).alias("log_pages"),
        )
        .join(online, ["server_id", "database_id"])
        .withColumns(
            grade(
                (F.col("log_pages") > F.col("data_pages") * 2, CRITICAL, "log_over_twice_data"),
                (F.col("log_pages") > F.col("data_pages"), ATTENTION, "log_over_data"),
            )
        )
        .select("server_id", "name", "data_mb", "log_mb", "severity", "reason")
    )


def log_segments(t: Telemetry) -> DataFrame:
    """Virtual log files per database, with the total size."""
    log = t["log_vlf"]
    counted = log.groupBy(*snapshot_keys(log), "database_id").agg(
        F.count("*").alias("segments"),
        count_where(F.col("vlf_active") == 1).alias("active"),
    )
    return with_database(counted, t).withColumns(_segment_ladder())


def log_segment_size(t: Telemetry) -> DataFrame:
    log = t["log_vlf"]
    return (
        log.groupBy(*snapshot_keys(log), "database_id")
        .agg(
            F.count("*").alias("segments"),
            ratio(F.sum("vlf_size_kb"), F.lit(1024), 10, 1).alias("total_mb"),
        )
        .withColumns(_segment_ladder())
    )


def _segment_ladder() -> dict:
    return grade(
        (F.col("segments") > 1000, CRITICAL, "severe_fragmentation"),
        (F.col("segments") > 200, ATTENTION, "above_recommended"),
    )


def growth_settings(t: Telemetry) -> DataFrame:
    """Autogrowth settings; sort_bucket puts percent growth first, small steps next."""
    percent_growth = F.col("is_percent_growth") == 1
    growth_mb = pages_to_mb("growth")
    return (
        t["file_dim"]
        .where(F.col("database_id") > 4)
        .select(
            "server_id", "database_id", "file_name", "type", pages_to_mb("size_pages").alias("size_mb"),
            F.when(percent_growth, F.concat(F.col("growth").cast("string"), F.lit("%")))
            .otherwise(F.concat(growth_mb.cast("string"), F.lit(" MB")))
            .alias("autogrowth"),
            F.when(percent_growth, 0).when(growth_mb < 256, 1).otherwise(2).alias("sort_bucket"),
            *[
                c.alias(n)
                for n, c in grade(
                    (percent_growth & (pages_to_mb("size_pages") > 10240), CRITICAL, "percent_growth_over_10gb"),
                    (percent_growth, ATTENTION, "percent_growth"),
                    ((growth_mb < 256) & (F.col("type") == DATA_FILE), ATTENTION, "data_step_under_256mb"),
                    ((growth_mb < 512) & (F.col("type") == LOG_FILE), ATTENTION, "log_step_under_512mb"),
                ).items()
            ],
        )
    )


def io_share(t: Telemetry) -> DataFrame:
    """Share of the server's reads and writes per database.

    The window runs over the aggregated rows, of which a server has one per database
    (at most 32,767 by product limit), so no group grows with the file history.
    """
    io = t["file_io"]
    keys = snapshot_keys(io)
    summed = with_database(
        io.groupBy(*keys, "database_id")
        .agg(
            F.sum("num_of_reads").alias("reads"),
            F.sum("num_of_writes").alias("writes"),
            F.sum("num_of_bytes_read").alias("bytes_read"),
            F.sum("num_of_bytes_written").alias("bytes_written"),
        ),
        t,
        "inner",
    )
    server = Window.partitionBy(*keys)
    return (
        summed.withColumns(
            {"all_reads": F.sum("reads").over(server), "all_writes": F.sum("writes").over(server)}
        )
        .select(
            *keys, "database_id", "database_name", "reads", "writes",
            ratio("bytes_read", F.lit(BYTES_PER_GB), 10, 2).alias("read_gb"),
            ratio("bytes_written", F.lit(BYTES_PER_GB), 10, 2).alias("written_gb"),
            percent("reads", "all_reads", 5, 1).alias("read_share_pct"),
            percent("writes", "all_writes", 5, 1).alias("write_share_pct"),
        )
        .withColumns(
            grade(
                (F.col("read_share_pct") > 70, ATTENTION, "dominates_reads"),
                (F.col("write_share_pct") > 70, ATTENTION, "dominates_writes"),
            )
        )
    )
