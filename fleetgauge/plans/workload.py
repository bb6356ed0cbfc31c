"""Query, procedure, trigger and plan-cache rankings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetgauge.functions.numbers import count_where, idiv, percent
from fleetgauge.functions.severity import ATTENTION, CRITICAL, grade
from fleetgauge.functions.text import statement_slice
from fleetgauge.operators.topk import top_per
from fleetgauge.plans.lookups import having_text, with_database, with_text
from fleetgauge.sources.telemetry import Telemetry, snapshot_keys

CACHED_TYPES = ("Adhoc", "Prepared", "Proc")
# The measures a cache ranking can sort by.
CACHE_ORDERS = {
    "cpu": "total_worker_time",
    "reads": "total_logical_reads",
    "duration": "total_elapsed_time",
    "memory grant": "max_grant_kb",
    "executions": "execution_count",
}


def _averages(rows: DataFrame, duration: str) -> DataFrame:
    runs = "execution_count"
    return rows.withColumns(
        {
            "avg_cpu_us": idiv("total_worker_time", runs),
            duration: idiv("total_elapsed_time", runs),
            "avg_reads": idiv("total_logical_reads", runs),
        }
    ).withColumnRenamed("total_worker_time", "total_cpu_us").drop("total_elapsed_time", "total_logical_reads")


def _cpu_rungs(critical: int, attention: int):
    return (
        (F.col("avg_cpu_us") > critical, CRITICAL, "avg_cpu_critical"),
        (F.col("avg_cpu_us") > attention, ATTENTION, "avg_cpu_high"),
    )


def query_cpu(t: Telemetry, top: int = 20) -> DataFrame:
    """The statements with most total CPU on every server."""
    stats = having_text(t["query_stats"], t)
    ranked = top_per(stats, snapshot_keys(stats), [F.desc("total_worker_time"), "query_hash"], top)
    rows = with_database(with_text(_averages(ranked, "avg_elapsed_us"), t), t)
    return rows.select(
        *snapshot_keys(stats), "rank", "query_hash", "avg_cpu_us", "total_cpu_us", "execution_count", "avg_elapsed_us",
        "avg_reads", "last_execution_time", "database_name",
        statement_slice("text", "statement_start_offset", "statement_end_offset").alias("statement"),
    ).withColumns(grade(*_cpu_rungs(1_000_000, 100_000)))


def _procedures(t: Telemetry, top: int) -> DataFrame:
    stats = t["proc_stats"].where(F.col("proc_name").isNotNull())
    ranked = top_per(stats, snapshot_keys(stats), [F.desc("total_worker_time"), "object_id"], top)
    return _averages(with_database(ranked, t), "avg_duration_us").drop("database_id")


def procedure_cpu(t: Telemetry, top: int = 20) -> DataFrame:
    return _procedures(t, top).withColumns(grade(*_cpu_rungs(1_000_000, 100_000)))


def procedure_ranking(t: Telemetry, top: int = 20) -> DataFrame:
    """As procedure_cpu, with a rung for procedures that read very much."""
    return _procedures(t, top).withColumns(
        grade(*_cpu_rungs(1_000_000, 100_000), (F.col("avg_reads") > 100_000, ATTENTION, "avg_reads_high"))
    )


def trigger_cpu(t: Telemetry, top: int = 20) -> DataFrame:
    """The triggers with most CPU; stats meet the catalogue within server and database."""
    dim = t["trigger_dim"].select("server_id", "database_id", "object_id", "name", "parent_name")
    joined = t["trigger_stats"].join(dim, ["server_id", "database_id", "object_id"])
    keys = snapshot_keys(joined)
    ranked = top_per(joined, keys, [F.desc("total_worker_time"), "object_id"], top)
    return with_database(ranked, t).select(
        *keys, "rank", F.col("name").alias("trigger_name"), F.col("parent_name").alias("parent_table"),
        "database_name", idiv("total_worker_time", "execution_count").alias("avg_cpu_us"),
        F.col("total_worker_time").alias("total_cpu_us"), "execution_count",
        idiv("total_elapsed_time", "execution_count").alias("avg_duration_us"), "last_execution_time",
    ).withColumns(grade(*_cpu_rungs(500_000, 100_000)))


def trigger_inventory(t: Telemetry) -> DataFrame:
    triggers = t["trigger_dim"]
    dates = [c for c in ("create_date", "modify_date") if c in triggers.columns]
    return (
        triggers.where(F.col("parent_class") == "OBJECT_OR_COLUMN")
        .select(
            "server_id", "database_id", F.col("name").alias("trigger_name"),
            F.col("parent_name").alias("parent_table"), "is_disabled", *dates,
        )
        .withColumns(grade((F.col("is_disabled") == 1, ATTENTION, "disabled")))
    )


def cached_plans(t: Telemetry, top: int = 50) -> DataFrame:
    """The most used cached plans of every server."""
    plans = t["cached_plan"].where(F.col("objtype").isin(*CACHED_TYPES) & F.col("database_id").isNotNull())
    plans = having_text(plans, t)
    ranked = top_per(plans, snapshot_keys(plans), [F.desc("usecounts"), "plan_handle"], top)
    rows = with_database(with_text(ranked, t, 200, "query"), t)
    return rows.select(
        *snapshot_keys(plans), "rank", "plan_handle", "usecounts", idiv("size_in_bytes", 1024).alias("size_kb"),
        "objtype", "database_name", "query",
    ).withColumns(
        grade(
            (F.col("usecounts") == 1, ATTENTION, "single_use"),
            (F.col("usecounts") > 100_000, ATTENTION, "high_volume"),
        )
    )


def single_use_ratio(t: Telemetry) -> DataFrame:
    plans = t["cached_plan"].where(F.col("objtype").isin(*CACHED_TYPES))
    return (
        plans.groupBy(*snapshot_keys(plans), "objtype")
        .agg(
            F.count("*").alias("plans"),
            count_where(F.col("usecounts") == 1).alias("single_use"),
            idiv(idiv(F.sum("size_in_bytes"), 1024), 1024).alias("total_mb"),
        )
        .withColumn("single_use_pct", percent("single_use", "plans", 5, 1))
        .withColumns(
            grade(
                (F.col("single_use_pct") > 40, CRITICAL, "enable_ad_hoc_optimisation"),
                (F.col("single_use_pct") > 20, ATTENTION, "many_single_use_plans"),
            )
        )
    )


def cache_top(t: Telemetry, order: str = "cpu", top: int = 10) -> DataFrame:
    """The cached statements that lead by one measure, per server."""
    stats = t["query_stats"]
    ranked = top_per(stats, snapshot_keys(stats), [F.desc(CACHE_ORDERS[order]), "query_hash"], top)
    return ranked.select(
        F.lit(order).alias("sort_order"), *snapshot_keys(stats), "rank", "query_hash", "execution_count",
        "total_worker_time", "total_logical_reads", "total_elapsed_time", "max_grant_kb",
    )
