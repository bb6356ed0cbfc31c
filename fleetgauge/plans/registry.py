"""Named reports as the correctness check and the bench run them."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from datetime import datetime, timedelta
from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetgauge.plans import (
    baseline, blocking, column_stats, findings, history, indexes, query_store, servers, sessions, sketches, statistics, storage, waiting, workload,
)
from fleetgauge.functions.timeunits import instant
from fleetgauge.operators.running import frequencies
from fleetgauge.session import prepare, work_path
from fleetgauge.sources.base_tables import read_base
from fleetgauge.sources.derived import DERIVED
from fleetgauge.sources.sinks import save_bucketed
from fleetgauge.sources.telemetry import Telemetry
from fleetgauge.streaming.registry import STREAMS

EVENTS_NOW = datetime(2024, 1, 31)
ORDERS_NOW = datetime(2001, 8, 2)
DAY = timedelta(hours=24)
MONTH = timedelta(days=30)



def _age(phase: str) -> str:
    """Captures of the first phase read the earlier state of the counters."""
    return "_earlier" if phase == baseline.BEFORE else ""


def _usage_capture(t: Telemetry, phase: str) -> DataFrame:
    return baseline.capture_index_usage(t, phase, EVENTS_NOW, usage=f"index_usage{_age(phase)}")


def _fragmentation_capture(t: Telemetry, phase: str) -> DataFrame:
    return baseline.capture_fragmentation(
        t, phase, EVENTS_NOW, physical=f"index_physical{_age(phase)}", operational=f"index_operational{_age(phase)}"
    )


def _wait_capture(t: Telemetry, phase: str) -> DataFrame:
    return baseline.capture_waits(t, phase, EVENTS_NOW, waits=f"wait_snapshot{_age(phase)}")


def _both_phases(capture: Callable[[Telemetry, str], DataFrame], t: Telemetry) -> DataFrame:
    return capture(t, baseline.BEFORE).unionByName(capture(t, baseline.AFTER_7D))


#: A fleet exported several times: captures on two days, readings before, at and after the second.
CAPTURE_DAYS, READING_DAYS = (10, 20), (15, 20, 25)
COUNTED = {
    "wait_snapshot": ("waiting_tasks_count", "wait_time_ms", "signal_wait_time_ms", "max_wait_time_ms"),
    "index_usage": ("user_seeks", "user_scans", "user_lookups", "user_updates"),
}


def exported_often(t: Telemetry) -> Telemetry:
    """Counters as read on several days of January 2024: the n-th capture holds n times the counts, the n-th reading n + 1 times."""
    tables = {}
    for name, counters in COUNTED.items():
        for table, days, more in ((f"{name}_earlier", CAPTURE_DAYS, 1), (name, READING_DAYS, 2)):
            times = F.array(*[
                F.struct(instant(datetime(2024, 1, d)).alias("snapshot_ts"), F.lit(n + more).alias("n")) for n, d in enumerate(days)
            ])
            rows = t[table].withColumn("_export", F.explode(times))
            scaled = {c: F.col(c) * F.col("_export.n") for c in counters if c in rows.columns}
            tables[table] = rows.withColumns({**scaled, "snapshot_ts": F.col("_export.snapshot_ts")}).drop("_export")
    return t.replaced(**tables)


def sampled_twice(t: Telemetry) -> Telemetry:
    """Requests as a sampler of twice the rate sees them: every state lasts from one sample to the next, half an hour later."""
    times = F.array("snapshot_ts", F.col("snapshot_ts") + F.expr("INTERVAL 30 MINUTES"))
    return t.replaced(request_snapshot=t["request_snapshot"].withColumn("snapshot_ts", F.explode(times)))


def _exports_delta(t: Telemetry) -> DataFrame:
    often = exported_often(t)
    return waiting.wait_delta(waiting.capture_waits(often, "wait_snapshot_earlier"), often["wait_snapshot"])


REPORTS: dict[str, Callable[[Telemetry], DataFrame]] = {
    "q01_uptime_confidence": lambda t: servers.uptime_confidence(t, EVENTS_NOW),
    "q02_activity_log_latest": sessions.activity_log_latest,
    "q03_active_requests": sessions.active_requests,
    "q04a_query_cpu": workload.query_cpu,
    "q04b_proc_cpu": workload.procedure_cpu,
    "q04c_wait_capture": lambda t: waiting.capture_waits(t, "wait_snapshot_earlier"),
    "q04d_wait_delta": lambda t: waiting.wait_delta(
        waiting.capture_waits(t, "wait_snapshot_earlier"), t["wait_snapshot"]
    ),
    "q04e_wait_delta_exports": _exports_delta,
    "q05_wait_ranking": waiting.wait_ranking,
    "q06_blocking_pairs": sessions.blocking_pairs,
    "q07a_session_groups": lambda t: sessions.session_groups(t, EVENTS_NOW),
    "q07b_idle_sessions": lambda t: sessions.idle_sessions(t, EVENTS_NOW),
    "q07c_connections_per_db": sessions.connections_per_database,
    "q08_missing_indexes": indexes.missing_indexes,
    "q09a_fragmentation": indexes.fragmentation,
    "q09b_maintenance_log": history.maintenance_log,
    "q10_unused_indexes": indexes.unused_indexes,
    "q11_proc_ranking": workload.procedure_ranking,
    "q12a_trigger_cpu": workload.trigger_cpu,
    "q12b_trigger_inventory": workload.trigger_inventory,
    "q13a_qs_capacity": servers.query_store_capacity,
    "q13b_qs_top_duration": lambda t: query_store.top_duration(t, EVENTS_NOW),
    "q13c_plan_regression_pairs": lambda t: query_store.regression_pairs(t, EVENTS_NOW, DAY, MONTH),
    "q14a_memory_grants": servers.memory_grants,
    "q14b_grant_summary": servers.grant_summary,
    "q15a_temp_space": servers.temp_space,
    "q15b_temp_by_session": servers.temp_by_session,
    "q16a_process_memory": servers.process_memory,
    "q16b_page_life": servers.page_life,
    "q16c_memory_cap": servers.memory_cap,
    "q16d_buffer_by_db": servers.buffer_by_database,
    "q17a_file_latency": storage.file_latency,
    "q17b_volume_space": storage.volume_space,
    "q18_stale_stats": lambda t: statistics.stale_statistics(t, EVENTS_NOW),
    "q19a_cached_plans": workload.cached_plans,
    "q19b_single_use_ratio": workload.single_use_ratio,
    "q20a_backup_age": lambda t: history.backup_age(t, ORDERS_NOW),
    "q20b_log_reuse": storage.log_reuse,
    "q20c_log_vs_data": storage.log_versus_data,
    "q21_integrity_age": lambda t: history.integrity_age(t, EVENTS_NOW),
    "q22_job_failures": lambda t: history.job_failures(t, EVENTS_NOW),
    "q23a_config_audit": servers.config_audit,
    "q23b_database_options": servers.database_options,
    "q23c_server_uptime": lambda t: servers.server_uptime(t, EVENTS_NOW),
    "q24a_vlf_by_db": storage.log_segments,
    "q24b_vlf_size": storage.log_segment_size,
    "q25_autogrowth": storage.growth_settings,
    "q26a_collect_sessions": lambda t: sessions.collected_sessions(t, EVENTS_NOW, own_session=51),
    "q26b_collect_waits": lambda t: waiting.collected_waits(t, EVENTS_NOW),
    "q26c_collect_blocks": lambda t: sessions.collected_blocks(t, EVENTS_NOW),
    "q26d_hourly_history": lambda t: history.hourly_sessions(t, EVENTS_NOW),
    "q27_maintenance_log": history.maintenance_log,
    "q28a_capture_index_usage": lambda t: _usage_capture(t, baseline.BEFORE),
    "q28b_capture_fragmentation": lambda t: _fragmentation_capture(t, baseline.BEFORE),
    "q28c_capture_waits": lambda t: _wait_capture(t, baseline.BEFORE),
    "q28d_capture_after": lambda t: _usage_capture(t, baseline.AFTER_7D),
    "q28e_index_usage_delta": lambda t: baseline.index_usage_delta(_both_phases(_usage_capture, t)),
    "q28f_fragmentation_delta": lambda t: baseline.fragmentation_delta(_both_phases(_fragmentation_capture, t)),
    "q28g_wait_change": lambda t: baseline.wait_change(_both_phases(_wait_capture, t)),
    "q28h_qs_reads_impact": lambda t: query_store.reads_impact(t, EVENTS_NOW, ["t1", "t2", "t3", "t4"]),
    "q28i_index_usage_exports": lambda t: baseline.index_usage_delta(_both_phases(_usage_capture, exported_often(t))),
    "q28j_wait_change_exports": lambda t: baseline.wait_change(_both_phases(_wait_capture, exported_often(t))),
    "q29a_grant_queue": servers.grant_queue,
    "q29b_wait_actions": waiting.wait_actions,
    "q29c_qs_recent": lambda t: query_store.recent_queries(t, EVENTS_NOW),
    "q30a_stats_diagnosis": lambda t: statistics.statistics_diagnosis(t, EVENTS_NOW),
    "q30e_filtered_stats": lambda t: statistics.filtered_statistics(t, EVENTS_NOW),
    "q31a_backup_growth": lambda t: history.backup_growth(t, ORDERS_NOW),
    "q31b_monthly_size": lambda t: history.monthly_size(t, ORDERS_NOW),
    "q32a_availability": lambda t: servers.availability(t, EVENTS_NOW),
    "q32b_restart_events": lambda t: history.restart_events(t, ("license", "and the")),
    "q33_io_share": storage.io_share,
    # The derived load changes on the last day, so the day is compared with its month;
    # the _1h entry keeps the default periods.
    "q34a_regressions": lambda t: query_store.regressions(t, EVENTS_NOW, DAY, MONTH),
    "q34a_regressions_1h": lambda t: query_store.regressions(t, EVENTS_NOW),
    "q34b_plan_list": query_store.plan_list,
    "q35_rows_per_table": statistics.rows_per_table,
    "x02_activity": lambda t: sessions.activity(
        t, include=("database", "DB_7"), exclude=("program", "signup"), sort_by="elapsed_time", top=10
    ),
    "x03_block_leaders": blocking.block_leaders,
    "x04_two_sample_delta": waiting.sampled_deltas,
    "x04b_delta_since_startup": lambda t: waiting.sampled_deltas(t, since_startup=True),
    "x05_cache_topk": lambda t: reduce(
        DataFrame.unionByName, [workload.cache_top(t, order) for order in workload.CACHE_ORDERS]
    ),
    "x06_deadlock_window": lambda t: blocking.mutual_waits(
        t, datetime(2024, 1, 30, 19), datetime(2024, 1, 30, 23)
    ),
    "x06b_deadlock_counts": lambda t: blocking.mutual_wait_counts(
        t, datetime(2024, 1, 30, 19), datetime(2024, 1, 30, 23)
    ),
    "x06c_deadlock_events": lambda t: blocking.mutual_wait_events(sampled_twice(t), datetime(2024, 1, 30, 19), datetime(2024, 1, 30, 23)),
    "x07_index_review": indexes.index_review,
    "x08_maintenance_plan": indexes.maintenance_plan,
    "x16_parameter_spread": column_stats.parameter_spread,
    "x17_safe_drop_gate": lambda t: indexes.safe_drop_gate(t, EVENTS_NOW),
    "x18_scan_mode_gate": statistics.scan_mode_gate,
    "x19_wait_playbook": waiting.dominant_wait,
    "x20_updatestats_scope": statistics.refresh_scope,
    "x21_growth_forecast": lambda t: history.growth_forecast(t, ORDERS_NOW),
    "x21b_growth_after_shifts": lambda t: history.growth_after_shifts(t, ORDERS_NOW),
}


REPORTS["x01_findings_feed"] = lambda t: findings.findings_feed(
    t, findings.store_findings(t, REPORTS, work_path(t.spark, "findings"))
)


@contextmanager
def _lines_by_part(spark: SparkSession, folder: str) -> Iterator[DataFrame]:
    """The lines in a table bucketed by part for as long as reports run: what sums them by part moves sums at most, no lines."""
    path, buckets = work_path(spark, "lines-by-part"), int(spark.conf.get("spark.sql.shuffle.partitions"))
    lines, table = read_base(spark, folder, "lineitem"), f"lines_by_part_{path[-32:]}"
    lines = lines.select(*[c for c in lines.columns if any(c in DERIVED[n] for n in BY_PART)])
    save_bucketed(lines.repartition(buckets, "l_partkey"), table, ["l_partkey"], buckets, path)
    try:
        yield spark.table(table)
    finally:
        spark.sql(f"DROP TABLE {table}")


#: Derived tables of the feed that sum lines by part and more keys.
BY_PART = (
    "query_stats", "proc_stats", "trigger_stats", "index_usage", "index_usage_earlier", "index_operational",
    "index_operational_earlier", "file_io",
)


def _feed(spark: SparkSession, folder: str) -> DataFrame:
    """The findings feed, whose reports share what several of them would shuffle."""
    t = Telemetry.derived(prepare(spark), folder)
    with _lines_by_part(spark, folder) as lines:
        by_part = Telemetry.derived(spark, folder, lineitem=lines)
        waits = t["wait_snapshot"].persist(StorageLevel.DISK_ONLY)
        shared = t.replaced(wait_snapshot=waits, **{name: by_part[name] for name in BY_PART})
        try:
            stored = findings.store_findings(shared, REPORTS, work_path(spark, "findings"))
        finally:
            waits.unpersist()
    return plain(findings.findings_feed(t, stored))


# Column statistics read a table itself, not telemetry.
COLUMN_REPORTS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "x09_histogram": lambda lines: column_stats.histogram(lines, "l_partkey"),
    "x09b_histogram_dates": lambda lines: column_stats.histogram(lines, "l_shipdate", 50),
    "x10_stat_header": lambda lines: column_stats.headers(lines, ["l_partkey", "l_suppkey", "l_returnflag"], EVENTS_NOW),
    "x11_density_vector": lambda lines: column_stats.density_vector(
        lines, ["l_returnflag", "l_suppkey", "l_linenumber"]
    ),
    "x12_filtered_stats": lambda lines: column_stats.histogram(
        lines, "l_suppkey", where=F.col("l_shipdate") >= instant(datetime(2000, 1, 1))
    ),
    "x13_sampled_stats": lambda lines: column_stats.sampled_histogram(
        lines, "l_partkey", 30, (F.col("l_orderkey") * 7919 + F.col("l_linenumber") * 104729) % 100
    ),
    "x14_estimate_vs_actual": lambda lines: column_stats.estimates(
        column_stats.histogram(lines, "l_shipdate", where=F.col("l_shipdate") < instant(datetime(1999, 1, 1))),
        frequencies(lines, [], "l_shipdate"),
    ),
    "x15_skew": lambda lines: column_stats.skew(
        lines, ["l_returnflag", "l_linestatus", "l_suppkey", "l_partkey", "l_linenumber"]
    ),
}
def _refreshed_statistics(lines: DataFrame) -> DataFrame:
    """Statistics of lineitem by year of shipment, stored, refreshed after one year has grown, merged, and held against exact counts."""
    spark, columns = lines.sparkSession, ["l_partkey", "l_suppkey", "l_quantity", "l_returnflag"]
    table, store = work_path(spark, "by-year"), work_path(spark, "sketches")
    by_year = lines.select(*columns, F.year("l_shipdate").alias("year"))
    last = by_year.agg(F.max("year").alias("y")).first()["y"]
    rows = by_year.where(F.col("year") < last) if last else by_year
    rows.write.partitionBy("year").parquet(table)
    sketches.refresh(spark, table, store, columns, "year")
    by_year.where(F.col("year") == last).write.mode("append").partitionBy("year").parquet(table)
    again = sketches.refresh(spark, table, store, columns, "year")
    found = sketches.statistics(sketches.merged(sketches.stored(spark, table, store, "year")), (0.5,))
    counted = by_year.select(*columns).agg(*[F.countDistinct(c).alias(c) for c in columns]).unpivot([], columns, "column_name", "exact")
    close = F.abs(F.col("distinct_values") - F.col("exact")) <= F.ceil(F.col("exact") * sketches.DISTINCT_ERROR)
    return found.join(counted, "column_name").select(
        "column_name", "rows", "null_rows", "low", "high", close.alias("distinct_within_bound"), F.lit(len(again)).alias("partitions_read_again")
    )


COLUMN_REPORTS["x22_merged_statistics"] = _refreshed_statistics
COLUMN_REPORTS["x15b_heavy_values"] = lambda lines: column_stats.heavy_hitters(
    lines, ["l_returnflag", "l_linestatus", "l_linenumber", "l_quantity", "l_partkey"], 0.01
)


# Integers that may be missing; data frames of different engines type them differently.
NULLABLE_INTEGERS = ("error_number", "hours_since_full", "days_since_check", "days_to_capacity")


def plain(df: DataFrame) -> DataFrame:
    """Decimals (and integers with gaps) as doubles, so that results compare the same
    across engines."""
    return df.select(
        *[
            F.col(f.name).cast("double").alias(f.name)
            if f.dataType.typeName() == "decimal" or f.name in NULLABLE_INTEGERS else F.col(f.name)
            for f in df.schema.fields
        ]
    )


def as_query(report: Callable[[Telemetry], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return plain(report(Telemetry.derived(prepare(spark), folder)))

    return run


def as_column_query(report: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return plain(report(read_base(prepare(spark), folder, "lineitem")))

    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = {name: as_query(report) for name, report in REPORTS.items()}
    named |= {name: as_column_query(report) for name, report in COLUMN_REPORTS.items()} | {"x01_findings_feed": _feed}
    return dict(sorted((named | STREAMS).items()))
