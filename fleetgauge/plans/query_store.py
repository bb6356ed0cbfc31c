"""Query Store: heavy queries, plan changes, regressions.

Every report cuts the runtime facts to their time range, sums them to one row per plan
(map-side combined, so a plan with very many intervals is no hot spot), and only then
meets the plan, query and text dimensions.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetgauge.functions.numbers import idiv, ratio
from fleetgauge.functions.severity import ATTENTION, CRITICAL, OK, grade
from fleetgauge.functions.text import contains_any
from fleetgauge.functions.timeunits import instant
from fleetgauge.operators.topk import top_per
from fleetgauge.sources.telemetry import Telemetry

MEASURES = {"duration": "avg_duration", "cpu": "avg_cpu_time", "reads": "avg_logical_io_reads"}


def runtime_since(t: Telemetry, since: datetime) -> DataFrame:
    """Runtime rows of the intervals that start at ``since`` or later, with start_time.

    A row of such an interval was last executed at ``since`` or later too, which lets
    the scan of the facts skip older row groups.
    """
    facts = t["qs_runtime"].where(F.col("last_execution_time") >= instant(since))
    intervals = t["qs_interval"].where(F.col("start_time") >= instant(since))
    return facts.join(intervals, ["server_id", "interval_id"])


def _sums(weighted: bool, when: Column | None = None, prefix: str = "") -> list[Column]:
    def pick(value: Column) -> Column:
        return value if when is None else F.when(when, value)

    runs = F.col("count_executions")
    weight = runs if weighted else F.lit(1)
    out = [
        F.sum(pick(weight)).alias(f"{prefix}n"),
        F.sum(pick(runs)).alias(f"{prefix}executions"),
        F.max(pick(F.col("last_execution_time"))).alias(f"{prefix}last_execution"),
    ]
    out += [F.sum(pick(F.col(c) * weight)).alias(f"{prefix}{m}") for m, c in MEASURES.items()]
    return out


def _regroup(prefix: str = "") -> list[Column]:
    out = [F.sum(f"{prefix}{c}").alias(f"{prefix}{c}") for c in ("n", "executions", *MEASURES)]
    return [*out, F.max(f"{prefix}last_execution").alias(f"{prefix}last_execution")]


def _per_query(t: Telemetry, per_plan: DataFrame, aggregates: list[Column]) -> DataFrame:
    plans = t["qs_plan"].select("server_id", "plan_id", "query_id")
    return per_plan.join(plans, ["server_id", "plan_id"]).groupBy("server_id", "query_id").agg(*aggregates)


def _with_query_text(t: Telemetry, rows: DataFrame) -> DataFrame:
    """Texts of ranked rows, a few for each server."""
    queries = t["qs_query"].select("server_id", "query_id", "query_text_id")
    return rows.join(queries, ["server_id", "query_id"]).join(t["qs_text"], ["server_id", "query_text_id"])


def _having_text(t: Telemetry, rows: DataFrame, texts: DataFrame | None = None) -> DataFrame:
    """Keep the rows of queries whose text is known, without carrying the text along."""
    ids = (t["qs_text"] if texts is None else texts).select("server_id", "query_text_id")
    known = t["qs_query"].select("server_id", "query_id", "query_text_id").join(ids, ["server_id", "query_text_id"], "left_semi")
    return rows.join(known.select("server_id", "query_id"), ["server_id", "query_id"], "left_semi")


def _averages(rows: DataFrame) -> DataFrame:
    return rows.withColumns(
        {
            "mean_us": F.col("duration") / F.col("n"),
            "avg_duration_ms": ratio("duration", F.col("n") * 1000, 18, 2),
            "avg_cpu_ms": ratio("cpu", F.col("n") * 1000, 18, 2),
            "avg_reads": idiv("reads", "n"),
        }
    )


def _longest(t: Telemetry, as_of: datetime, hours: int, top: int, weighted: bool) -> DataFrame:
    facts = runtime_since(t, as_of - timedelta(hours=hours))
    per_plan = facts.groupBy("server_id", "plan_id").agg(*_sums(weighted))
    queries = _per_query(t, per_plan, [*_regroup(), F.count("*").alias("plan_count")])
    rows = _averages(_having_text(t, queries))
    return _with_query_text(t, top_per(rows, ["server_id"], [F.desc("mean_us"), "query_id"], top))


def top_duration(t: Telemetry, as_of: datetime, hours: int = 24, top: int = 20, weighted: bool = False) -> DataFrame:
    """The queries with the longest average duration. Averages are over intervals,
    not executions, unless ``weighted``."""
    return _longest(t, as_of, hours, top, weighted).select(
        "server_id", "rank", "query_id", "query_sql_text", "executions", "avg_duration_ms", "avg_cpu_ms",
        "avg_reads", "plan_count", "last_execution",
        *_named(
            grade(
                (F.col("plan_count") > 3, CRITICAL, "many_plans"),
                (F.col("mean_us") > 5_000_000, CRITICAL, "over_5s"),
                (F.col("mean_us") > 1_000_000, ATTENTION, "over_1s"),
            )
        ),
    )


def recent_queries(t: Telemetry, as_of: datetime, hours: int = 4, top: int = 20) -> DataFrame:
    """The short form for incidents: the last hours, graded on duration only."""
    return _longest(t, as_of, hours, top, False).select(
        "server_id", "rank", "query_id", "query_sql_text", "executions", "avg_duration_ms", "avg_cpu_ms",
        "last_execution",
        *_named(
            grade(
                (F.col("mean_us") > 5_000_000, CRITICAL, "over_5s"),
                (F.col("mean_us") > 1_000_000, ATTENTION, "over_1s"),
            )
        ),
    )


def reads_impact(t: Telemetry, as_of: datetime, tables, days: int = 7, top: int = 20) -> DataFrame:
    """Queries that mention any of the given tables, by average reads."""
    facts = runtime_since(t, as_of - timedelta(days=days))
    per_plan = facts.groupBy("server_id", "plan_id").agg(*_sums(False))
    queries = _per_query(t, per_plan, [*_regroup(), F.count("*").alias("plan_count")])
    texts = t["qs_text"].where(contains_any("query_sql_text", tables))
    rows = _averages(_having_text(t, queries, texts)).withColumn("mean_reads", F.col("reads") / F.col("n"))
    ranked = _with_query_text(t, top_per(rows, ["server_id"], [F.desc("mean_reads"), "query_id"], top))
    return ranked.select(
        "server_id", "rank", "query_id", "query_sql_text", "executions", "avg_duration_ms", "avg_cpu_ms",
        "avg_reads", "plan_count",
        *_named(
            grade(
                (F.col("plan_count") > 3, CRITICAL, "many_plans"),
                (F.col("mean_reads") < 1000, OK, "low_reads"),
                (F.col("mean_reads") < 10000, ATTENTION, "moderate_reads"),
                otherwise=(CRITICAL, "very_high_reads"),
            )
        ),
    )


def _named(columns: dict[str, Column]) -> list[Column]:
    return [c.alias(n) for n, c in columns.items()]


def regressions(
    t: Telemetry, as_of: datetime, recent: timedelta = timedelta(hours=1),
    history: timedelta = timedelta(hours=24), top: int = 20, half_open: bool = False,
) -> DataFrame:
    """Queries that got slower: a recent period against the one before it.

    One pass over the facts fills both periods by conditional aggregation. An interval
    that starts exactly at the border counts in both periods unless ``half_open``.
    """
    border = instant(as_of - recent)
    start = F.col("start_time")
    is_recent = start >= border
    is_history = start < border if half_open else start <= border
    facts = runtime_since(t, as_of - history)
    per_plan = facts.groupBy("server_id", "plan_id").agg(
        *_sums(False, is_recent, "r_"), *_sums(False, is_history, "h_")
    )
    queries = _per_query(
        t, per_plan, [*_regroup("r_"), *_regroup("h_"), F.count("r_n").alias("plan_count")]
    ).where(F.col("r_n").isNotNull() & F.col("h_n").isNotNull())
    def exact(name: str) -> Column:
        """Wide enough that a product does not overflow."""
        return F.col(name).cast("decimal(19,0)")

    rows = queries.withColumns(
        {
            "r_mean": F.col("r_duration") / F.col("r_n"), "h_mean": F.col("h_duration") / F.col("h_n"),
            "r_mean_reads": F.col("r_reads") / F.col("r_n"), "h_mean_reads": F.col("h_reads") / F.col("h_n"),
            "factor": ratio(
                exact("r_duration") * exact("h_n"), exact("h_duration") * exact("r_n"), 20, 2
            ),
        }
    ).where(F.col("r_mean") > F.col("h_mean") * 1.5)
    ranked = _with_query_text(t, top_per(_having_text(t, rows), ["server_id"], [F.desc("factor"), "query_id"], top))
    return ranked.select(
        "server_id", "rank", "query_id", "query_sql_text",
        ratio("r_duration", F.col("r_n") * 1000, 18, 2).alias("recent_ms"),
        ratio("h_duration", F.col("h_n") * 1000, 18, 2).alias("history_ms"),
        ratio("r_cpu", F.col("r_n") * 1000, 18, 2).alias("recent_cpu_ms"),
        ratio("r_reads", "r_n", 18, 0).alias("recent_reads"),
        ratio("h_reads", "h_n", 18, 0).alias("history_reads"),
        "factor", F.col("r_executions").alias("recent_executions"),
        F.col("h_executions").alias("history_executions"), "plan_count", "r_last_execution",
        *_named(
            grade(
                (F.col("r_mean") > F.col("h_mean") * 5, CRITICAL, "slower_5x"),
                (F.col("r_mean") > F.col("h_mean") * 2, ATTENTION, "slower_2x"),
                (F.col("plan_count") > 3, ATTENTION, "many_plans"),
                (F.col("r_mean_reads") > F.col("h_mean_reads") * 3, ATTENTION, "reads_tripled"),
            )
        ),
    ).withColumnRenamed("r_last_execution", "last_execution")


def regression_pairs(
    t: Telemetry, as_of: datetime, recent: timedelta = timedelta(hours=1),
    history: timedelta = timedelta(hours=24), top: int = 20,
) -> DataFrame:
    """Recent against historical interval rows of the same plan, the worst pairs only.

    Pairing every recent row with every historical row of a plan would multiply them.
    A pair among the first ``top`` can only join one of the plan's ``top`` slowest
    recent rows with one of its ``top`` fastest historical rows (zero durations, whose
    factor is undefined, apart), so both sides are ranked first and few pairs are formed.
    The order (factor, then the slower recent row, then the faster historical row)
    makes that pruning exact.
    """
    border = instant(as_of - recent)
    start, duration = F.col("start_time"), F.col("avg_duration")
    # One pass over the facts: an interval on the border stands in both periods.
    periods = F.array_compact(
        F.array(F.when(start >= border, F.lit("recent")), F.when(start <= border, F.lit("history")))
    )
    facts = runtime_since(t, as_of - history).select(
        "server_id", "plan_id", "runtime_id", "avg_duration", "last_execution_time",
        (duration == 0).alias("is_zero"), F.explode(periods).alias("period"),
    )
    plan, is_recent = ["server_id", "plan_id"], F.col("period") == "recent"
    extreme = F.when(is_recent, -duration).otherwise(duration)
    ranked = top_per(facts, [*plan, "period", "is_zero"], [extreme, "runtime_id"], top)
    recent_row = F.struct(
        F.col("runtime_id").alias("recent_id"), duration.alias("r_us"),
        F.col("last_execution_time").alias("last_execution"),
    )
    history_row = F.struct(F.col("runtime_id").alias("history_id"), duration.alias("h_us"))
    # The lists hold at most 2 * top rows of a plan each.
    sides = ranked.groupBy(*plan).agg(
        F.collect_list(F.when(is_recent, recent_row)).alias("slow"),
        F.collect_list(F.when(~is_recent, history_row)).alias("fast"),
    )
    pairs = (
        sides.select(*plan, F.explode("slow").alias("r"), "fast")
        .select(*plan, "r.*", F.explode("fast").alias("h"))
        .select(*plan, "recent_id", "r_us", "last_execution", "h.*")
        .where(F.col("r_us") > F.col("h_us") * 2)
    )
    pairs = pairs.withColumn("factor", ratio("r_us", "h_us", 20, 2))
    queries = t["qs_plan"].select("server_id", "plan_id", "query_id")
    rows = _having_text(t, pairs.join(queries, plan))
    order = [
        F.desc_nulls_last("factor"), F.desc("r_us"), "recent_id", "h_us", "history_id",
    ]
    return _with_query_text(t, top_per(rows, ["server_id"], order, top)).select(
        "server_id", "rank", "query_id", "query_sql_text", "plan_id", "recent_id", "history_id",
        ratio("r_us", F.lit(1000), 18, 2).alias("recent_ms"),
        ratio("h_us", F.lit(1000), 18, 2).alias("history_ms"),
        "factor", "last_execution",
        *_named(
            grade(
                (F.col("r_us") > F.col("h_us") * 5, CRITICAL, "slower_5x"),
                (F.col("r_us") > F.col("h_us") * 2, ATTENTION, "slower_2x"),
            )
        ),
    )


def plan_list(t: Telemetry, query_id: int | None = None) -> DataFrame:
    """Plans of a query (or of all queries) in the order they first ran.

    The store keeps a bounded number of plans per query (200 unless configured), so the
    window sees small groups.
    """
    plans = t["qs_plan"]
    if query_id is not None:
        plans = plans.where(F.col("query_id") == query_id)
    in_query = Window.partitionBy("server_id", "query_id").orderBy("first_execution_time", "plan_id")
    return plans.withColumn("plan_order", F.row_number().over(in_query))
