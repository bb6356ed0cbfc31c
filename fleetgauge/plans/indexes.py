"""Indexes: missing, fragmented, unused; maintenance decisions and drop checks."""

from __future__ import annotations

from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetgauge.functions.numbers import ratio, zero_if_null
from fleetgauge.functions.severity import ATTENTION, OK, grade
from fleetgauge.functions.text import quote_name, strip_brackets
from fleetgauge.functions.timeunits import boundaries, instant
from fleetgauge.operators.topk import top_per
from fleetgauge.sources.telemetry import Telemetry, meet, snapshot_keys

# Above this many rows a full scan for statistics is replaced by a sample.
FULL_SCAN_ROWS = 10_000_000
# Fixed value: the options of the index command.
INDEX_OPTIONS = "FILLFACTOR=90, ONLINE=OFF, SORT_IN_TEMPDB=ON"


def missing_indexes(t: Telemetry, top: int = 30) -> DataFrame:
    """The most promising missing indexes of every database, with the statement to create them."""
    groups, stats, details = t["missing_index_group"], t["missing_index_stats"], t["missing_index_detail"]
    stats = stats.withColumn(
        "score",
        F.round(
            F.col("avg_total_user_cost") * F.col("avg_user_impact") * (F.col("user_seeks") + F.col("user_scans"))
        ).cast("bigint"),
    )
    groups = groups.withColumnRenamed("index_group_handle", "group_handle")
    joined = meet(meet(groups, stats, ["group_handle"]), details, ["index_handle"])
    keys = snapshot_keys(joined)
    ranked = top_per(joined, [*keys, "database_id"], [F.desc("score"), "index_handle"], top)
    equality, inequality = F.col("equality_columns"), F.col("inequality_columns")
    command = F.concat(
        F.lit("CREATE NONCLUSTERED INDEX IX_"), F.col("table_name"), F.lit("_"),
        strip_brackets(F.coalesce(equality, F.lit(""))),
        F.when(inequality.isNotNull(), F.concat(F.lit("_"), strip_brackets(inequality))).otherwise(""),
        F.lit(" ON "), F.col("table_name"), F.lit(" ("), F.coalesce(equality, F.lit("")),
        F.when(equality.isNotNull() & inequality.isNotNull(), ", ").otherwise(""),
        F.coalesce(inequality, F.lit("")), F.lit(")"),
        F.coalesce(F.concat(F.lit(" INCLUDE ("), F.col("included_columns"), F.lit(")")), F.lit("")),
        F.lit(f" WITH ({INDEX_OPTIONS})"),
    )
    return ranked.select(
        *keys, "database_id", "rank", "score", F.col("avg_user_impact").alias("benefit_pct"),
        "user_seeks", "user_scans", "table_name", "equality_columns", "inequality_columns",
        "included_columns", command.alias("create_command"),
    ).withColumns(
        grade(
            ((F.col("score") > 100_000) & (F.col("benefit_pct") > 70), "CREATE", "high_impact"),
            (F.col("score") > 10_000, "EVALUATE", "moderate_impact"),
            otherwise=("LOW", "low_priority"),
        )
    )


def _fragmentation() -> Column:
    return F.col("fragmentation_tenths")


def fragmentation(t: Telemetry) -> DataFrame:
    """Indexes of some size that are more than 10% fragmented."""
    physical = t["index_physical"].where((_fragmentation() > 100) & (F.col("page_count") > 100))
    names = t["index_dim"].where(F.col("index_name").isNotNull()).select(
        "server_id", "database_id", "index_id", "table_name", "index_name"
    )
    return (
        physical.join(names, ["server_id", "database_id", "index_id"])
        .withColumns(
            grade(
                (_fragmentation() > 300, "REBUILD", "critical_fragmentation"),
                (_fragmentation() > 100, "REORGANIZE", "moderate_fragmentation"),
            )
        )
        .select(
            *snapshot_keys(physical), "database_id", "table_name", "index_name",
            ratio("fragmentation_tenths", F.lit(10), 5, 1).alias("fragmentation_pct"), "page_count",
            ratio(F.col("page_count") * 8, F.lit(1024), 14, 1).alias("size_mb"), "severity", "reason",
        )
    )


def _usage(t: Telemetry, table: str = "index_usage") -> DataFrame:
    return t[table].withColumn("has_usage", F.lit(True))


def started_since(t: Telemetry) -> DataFrame:
    """When the counters of every server (and snapshot) began."""
    info = t["server_info"]
    return info.select(*snapshot_keys(info), F.col("start_time").alias("counters_since"))


def unused_indexes(t: Telemetry) -> DataFrame:
    """Secondary indexes with their use since the last restart."""
    indexes = t["index_dim"].where(
        (F.col("type_desc") != "HEAP") & (F.col("is_primary_key") == 0)
        & (F.col("is_unique_constraint") == 0) & (F.col("is_disabled") == 0)
    )
    # every index meets every snapshot of its server first, so that one without a row there shows
    started, usage = started_since(t), _usage(t)
    rows = indexes.join(started, "server_id", "left")
    rows = meet(rows, usage, ["index_id"], "left")
    counts = {k: zero_if_null(f"user_{k}") for k in ("seeks", "scans", "lookups", "updates")}
    reads = [counts[k] == 0 for k in ("seeks", "scans", "lookups")]
    never_read = reads[0] & reads[1] & reads[2]
    return rows.select(
        *snapshot_keys(started), "database_id", "table_name", "index_name",
        *[c.alias(k) for k, c in counts.items()], "last_user_seek",
        ratio(counts["seeks"], F.col("user_updates"), 12, 2).alias("seeks_per_update"), "counters_since",
        F.concat(F.lit("DROP INDEX "), quote_name("index_name"), F.lit(" ON "), quote_name("table_name")).alias(
            "drop_command"
        ),
        *[
            c.alias(n)
            for n, c in grade(
                (F.col("has_usage").isNull(), ATTENTION, "no_usage_since_restart"),
                (never_read & (counts["updates"] > 10_000), "REMOVE", "write_cost_only"),
                (counts["lookups"] > 10_000, ATTENTION, "many_lookups"),
                (counts["seeks"] > 1000, OK, "well_used"),
                (counts["seeks"] > 100, OK, "used"),
                otherwise=(ATTENTION, "little_used"),
            ).items()
        ],
    )


def safe_drop_gate(t: Telemetry, as_of: datetime, cycle_days: int = 31) -> DataFrame:
    """Unused indexes with the length of observation: no drop before a full business cycle."""
    observed = boundaries("day", "counters_since", instant(as_of))
    complete = F.col("observed_days") >= cycle_days
    unused = unused_indexes(t)
    return (
        unused.select(*snapshot_keys(unused), "database_id", "table_name", "index_name", "severity", "reason", observed.alias("observed_days"))
        .withColumn("drop_allowed", ((F.col("severity") == "REMOVE") & complete).cast("int"))
        .withColumn(
            "gate",
            F.when(F.col("severity") != "REMOVE", "not_a_candidate")
            .when(complete, "observed_full_cycle")
            .otherwise("wait_for_full_cycle"),
        )
    )


def index_review(t: Telemetry, database_id: int | None = None) -> DataFrame:
    """Missing, fragmented and unused indexes in one list, per database."""
    missing = missing_indexes(t)
    missing = missing.select(
        *snapshot_keys(missing), "database_id", F.lit("missing_index").alias("finding"), "table_name",
        F.lit(None).cast("string").alias("index_name"), "severity", "reason",
    )
    columns = missing.columns
    fragmented = fragmentation(t).withColumn("finding", F.lit("fragmentation")).select(*columns)
    unused = unused_indexes(t).withColumn("finding", F.lit("index_usage")).select(*columns)
    stacked = reduce(DataFrame.unionByName, [missing, fragmented, unused])
    return stacked if database_id is None else stacked.where(F.col("database_id") == database_id)


def maintenance_plan(
    t: Telemetry, level1: int = 10, level2: int = 30, min_pages: int = 100,
    medium: str = "REORGANIZE", high: str = "REBUILD", low: str = "NONE",
    modified_only: bool = True, databases=None, tables=None,
) -> DataFrame:
    """What to do with every index and its statistics; nothing is executed."""
    physical = t["index_physical"]
    indexes = t["index_dim"].where(F.col("index_name").isNotNull())
    if databases is not None:
        indexes = indexes.where(F.col("database_id").isin(*databases))
    if tables is not None:
        indexes = indexes.where(F.col("table_name").isin(*tables))
    stats = t["stats_properties"]
    stats = stats.select(
        *snapshot_keys(stats), "database_id", F.col("stats_id").alias("index_id"), "total_rows", "modification_counter"
    )
    named = physical.join(
        indexes.select("server_id", "database_id", "index_id", "table_name", "index_name"),
        ["server_id", "database_id", "index_id"],
    )
    rows = meet(named, stats, ["database_id", "index_id"], "left")
    large = F.col("page_count") >= min_pages
    update = F.col("modification_counter") > 0 if modified_only else F.col("modification_counter").isNotNull()
    return rows.select(
        *snapshot_keys(physical), "database_id", "table_name", "index_name", "page_count",
        ratio("fragmentation_tenths", F.lit(10), 5, 1).alias("fragmentation_pct"),
        # the levels are lower limits, inclusive
        F.when(large & (_fragmentation() >= level2 * 10), high)
        .when(large & (_fragmentation() >= level1 * 10), medium)
        .otherwise(low)
        .alias("index_action"),
        F.when(update, "UPDATE_STATISTICS").otherwise("NONE").alias("stats_action"),
        scan_mode().alias("scan_mode"),
    )


def scan_mode(rows="total_rows") -> Column:
    """Full scan or sample, by table size."""
    return F.when(F.col(rows) > FULL_SCAN_ROWS, "SAMPLE 30 PERCENT").otherwise("FULLSCAN")
