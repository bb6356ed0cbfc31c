"""Column statistics of any table: histogram, density, skew, estimate against actual."""

from __future__ import annotations

from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetgauge.functions.numbers import idiv, percent, ratio
from fleetgauge.functions.severity import ATTENTION, CRITICAL, grade
from fleetgauge.functions.timeunits import instant
from fleetgauge.operators.heavy import heavy_values
from fleetgauge.operators.running import cut_points, cuts_below, frequencies, value_counts, with_rows_below
from fleetgauge.sources.telemetry import Telemetry

MAX_STEPS = 200


def _steps(freq: DataFrame, steps: int) -> DataFrame:
    if not 1 <= steps <= MAX_STEPS:
        raise ValueError(f"a histogram has 1 to {MAX_STEPS} steps, not {steps}")
    placed = with_rows_below(freq).withColumn("step", idiv(F.col("below") * steps, "total"))
    grouped = placed.groupBy("step").agg(
        F.max("value").alias("range_hi_key"),
        F.max_by("rows", "value").alias("eq_rows"),
        F.sum("rows").alias("all_rows"),
        F.count("*").alias("values"),
    )
    others = F.col("values") - 1
    range_rows = F.col("all_rows") - F.col("eq_rows")
    return grouped.select(
        "step", "range_hi_key", range_rows.alias("range_rows"), "eq_rows",
        others.alias("distinct_range_rows"),
        F.when(others > 0, range_rows / others).otherwise(1.0).alias("avg_range_rows"),
    )


def histogram(df: DataFrame, column: str, steps: int = MAX_STEPS, where: Column | None = None) -> DataFrame:
    """Equi-depth histogram with at most ``steps`` steps.

    A value belongs to step floor(rows below it * steps / all rows). ``where`` makes it
    a filtered statistic; the predicate reaches the scan.
    """
    rows = df if where is None else df.where(where)
    return _steps(frequencies(rows, [], column), steps)


def header(
    df: DataFrame, column: str, updated: datetime, steps: int = MAX_STEPS,
    where: Column | None = None, approximate: bool = False, sample: Column | None = None, percent_rows: int = 100,
) -> DataFrame:
    """Rows, rows sampled, steps, density (1 / distinct values) and nulls of a column.

    With ``sample`` (an even hash of a row's key modulo 100) the statistic is of the rows
    below ``percent_rows``, while ``rows`` still counts the table. The approximate form is
    one pass of sketches: it groups nothing, and leaves the steps out, which need counts.
    """
    rows = df if where is None else df.where(where)
    whole = rows
    if sample is not None:
        rows = rows.where(sample < percent_rows)
    if approximate:
        return rows.agg(
            F.count("*").alias("rows_sampled"), (F.count("*") - F.count(column)).alias("null_rows"),
            F.approx_count_distinct(column).alias("distinct_values"),
        ).select(
            F.lit(column).alias("column_name"), instant(updated).alias("updated"),
            (F.col("rows_sampled") if sample is None else whole.agg(F.count("*")).scalar()).alias("rows"), "rows_sampled",
            "null_rows", "distinct_values", (F.lit(1.0) / F.nullif("distinct_values", F.lit(0))).alias("density"),
            F.lit(None).cast("bigint").alias("steps"),
        )
    counts = value_counts(rows, [], column)
    n = F.col("rows")
    step_count = _steps(counts.where(n > 0), steps).agg(F.count("*")).scalar()
    sums = counts.agg(
        F.coalesce(F.sum(F.abs(n)), F.lit(0)).alias("rows_sampled"),
        F.coalesce(F.sum(F.when(n < 0, -n)), F.lit(0)).alias("null_rows"),
        F.count("value").alias("distinct_values"),
    )
    total = F.col("rows_sampled") if sample is None else whole.agg(F.count("*")).scalar()
    return sums.select(
        F.lit(column).alias("column_name"), instant(updated).alias("updated"), total.alias("rows"), "rows_sampled", "null_rows", "distinct_values",
        (F.lit(1.0) / F.nullif("distinct_values", F.lit(0))).alias("density"), step_count.alias("steps"),
    )


#: Columns of the kinds that a header tells apart; values of one kind have one order.
KINDS = {
    "whole": ("bigint", ("tinyint", "smallint", "int", "bigint")), "number": ("double", ("float", "double")),
    "time": ("timestamp", ("date", "timestamp")), "text": ("string", ("string",)),
}


def _kind(data_type: str) -> tuple[str, str]:
    if data_type.startswith("decimal"):
        return "exact", "decimal(38,9)"
    return next(((k, to) for k, (to, types) in KINDS.items() if data_type in types), ("text", "string"))


def headers(df: DataFrame, columns, updated: datetime, steps: int = MAX_STEPS) -> DataFrame:
    """`header` of several columns in one read of the table.

    Values of all columns go through one aggregation, each in the field of its kind, so
    that they keep their order; running counts are per column.
    """
    types = dict(df.dtypes)
    fields = {kind: to for kind, to in sorted({_kind(types[c]) for c in columns})}

    def value(column: str) -> Column:
        own = F.col(column)
        cells = [(own if _kind(types[column])[0] == kind else F.lit(None)).cast(to).alias(kind) for kind, to in fields.items()]
        return F.struct(F.lit(column).alias("column_name"), F.when(own.isNotNull(), F.struct(*cells)).alias("value"))

    long = df.select(F.explode(F.array(*[value(c) for c in columns])).alias("c")).select("c.*")
    counts = value_counts(long, ["column_name"], "value")
    n = F.col("rows")
    placed = with_rows_below(counts.where((n > 0) | F.col("value").isNull()), ["column_name"])
    filled = F.col("value").isNotNull()
    # a null's count is negative and comes first: it shifts what lies below, and the total
    nulls = F.coalesce(F.max(F.when(~filled, -n)), F.lit(0))
    stepped = placed.join(placed.groupBy("column_name").agg(nulls.alias("nulls")), "column_name").withColumn(
        "step", F.when(filled, idiv((F.col("below") + F.col("nulls")) * steps, F.col("total") + F.col("nulls")))
    )
    return stepped.groupBy("column_name").agg(
        F.sum(F.abs(n)).alias("rows"), F.max("nulls").alias("null_rows"), F.count("step").alias("distinct_values"), F.count_distinct("step").alias("steps"),
    ).select(
        "column_name", instant(updated).alias("updated"), "rows", F.col("rows").alias("rows_sampled"), "null_rows", "distinct_values",
        (F.lit(1.0) / F.nullif("distinct_values", F.lit(0))).alias("density"), "steps",
    )


def density_vector(df: DataFrame, columns) -> DataFrame:
    """1 / distinct combinations for every prefix of the columns.

    Each shorter prefix is grouped from the next longer one, so only the longest
    prefix reads the table and later ones work on its distinct combinations.
    """
    n = F.col("n")
    rows, level = [], df.groupBy(*columns).agg(F.count("*").alias("n"))
    for length in range(len(columns), 0, -1):
        prefix = list(columns[:length])
        if length < len(columns):
            level = level.groupBy(*prefix).agg(F.sum("n").alias("n"))
        rows.append(
            level.where(n > 0).agg(F.count("*").alias("distinct_values")).select(
                F.lit(", ".join(prefix)).alias("columns"), F.lit(length).alias("prefix_length"),
                "distinct_values", (F.lit(1.0) / F.nullif("distinct_values", F.lit(0))).alias("density"),
            )
        )
    return reduce(DataFrame.unionByName, rows)


def sampled_histogram(
    df: DataFrame, column: str, percent_rows: int, bucket: Column, steps: int = MAX_STEPS
) -> DataFrame:
    """Histogram of a sample, scaled to the table.

    ``bucket`` is an even hash of a row's key modulo 100; rows below ``percent_rows``
    are the sample, so the same rows are taken on every run. 100 reads everything.
    """
    sample = df.where(bucket < percent_rows)
    freq = frequencies(sample, [], column)
    scaled = _steps(freq, steps)

    def up(name: str) -> Column:
        return ratio(F.col(name) * 100, F.lit(percent_rows), 18, 0).cast("bigint").alias(name)

    return scaled.select(
        "step", "range_hi_key", up("range_rows"), up("eq_rows"), "distinct_range_rows",
        F.lit(percent_rows).alias("sample_percent"),
        (F.col("range_rows") + F.col("eq_rows")).alias("rows_sampled"),
    )


def row_bucket(*columns: str) -> Column:
    """The default sampling bucket: a hash of the row's key, modulo 100."""
    return F.pmod(F.xxhash64(*columns), F.lit(100))


def estimates(steps: DataFrame, actual: DataFrame) -> DataFrame:
    """Estimated against actual rows for every value of ``actual`` (value, rows), and for every high key that has no rows any more.

    The estimate is the step's eq_rows when the value is its high key, else its average
    range rows; a value beyond the last step is estimated as one row. A histogram has
    at most MAX_STEPS steps, which is what makes the broadcast and the array safe.
    """
    numbered = steps.select(
        (F.row_number().over(Window.orderBy("range_hi_key")) - 1).alias("_position"),
        "range_hi_key", "eq_rows", "avg_range_rows",
    )
    gone = steps.select(F.col("range_hi_key").alias("value")).join(actual.select("value"), "value", "left_anti")
    actual = actual.select("value", "rows").unionByName(gone.withColumn("rows", F.lit(0).cast("bigint")))
    keys = cut_points(steps.select(F.col("range_hi_key").alias("value")))
    position = cuts_below(keys, F.col("value"))
    estimate = (
        F.when(F.col("range_hi_key").isNull(), 1.0)
        .when(F.col("value") == F.col("range_hi_key"), F.col("eq_rows").cast("double"))
        .otherwise(F.col("avg_range_rows"))
    )
    joined = actual.withColumn("_position", position).join(F.broadcast(numbered), "_position", "left")
    return graded_estimates(
        joined.select("value", F.col("rows").alias("actual_rows"), estimate.alias("estimated_rows"))
    )


def graded_estimates(rows: DataFrame, limit: int = 10) -> DataFrame:
    """q-error of an estimate, flagged beyond a factor of ten; a value without rows counts as one row."""
    estimate, actual = F.col("estimated_rows"), F.greatest(F.col("actual_rows"), F.lit(1))
    return rows.withColumn("q_error", F.greatest(estimate / actual, actual / estimate)).withColumns(
        grade((F.col("q_error") > limit, CRITICAL, "misestimated"))
    )


def skew(df: DataFrame, columns) -> DataFrame:
    """The share of the most frequent value of every column.

    All columns are counted in one pass; the leader of a column is a map-side maximum.
    """
    long = df.select(*[F.col(c).cast("string").alias(c) for c in columns]).unpivot(
        [], list(columns), "column_name", "value"
    )
    counted = long.groupBy("column_name", "value").agg(F.count("*").alias("n"))
    return (
        counted.groupBy("column_name")
        .agg(
            F.sum("n").alias("rows"), F.count("*").alias("distinct_values"),
            F.max(F.struct("n", "value")).alias("top"),
        )
        .select(
            "column_name", "rows", "distinct_values", F.col("top.value").alias("top_value"),
            F.col("top.n").alias("top_rows"), percent("top.n", "rows").alias("top_share_pct"),
        )
        .withColumns(
            grade(
                (F.col("top_share_pct") >= 90, CRITICAL, "dominant_value"),
                (F.col("top_share_pct") >= 50, ATTENTION, "skewed"),
            )
        )
    )


def heavy_hitters(df: DataFrame, columns, share: float = 0.01) -> DataFrame:
    """The values that hold more than a share of their column, with their rows; memory does not follow the distinct values."""
    long = df.select(*[F.col(c).cast("string").alias(c) for c in columns]).unpivot([], list(columns), "column_name", "value")
    return heavy_values(long, share).select(
        "column_name", "value", "rows", percent("rows", "total").alias("share_pct")
    ).withColumns(
        grade(
            (F.col("share_pct") >= 90, CRITICAL, "dominant_value"),
            (F.col("share_pct") >= 50, ATTENTION, "skewed"),
        )
    )


def parameter_spread(t: Telemetry) -> DataFrame:
    """How far apart the durations of one query lie: maximum over median and minimum.

    The median is the smallest value that at least half of the rows do not exceed,
    found from running counts of the distinct durations.
    """
    durations = (
        t["qs_runtime"].where(F.col("avg_duration").isNotNull())
        .select("server_id", "plan_id", F.col("avg_duration").alias("value"), "count_executions")
    )
    plans = t["qs_plan"].select("server_id", "plan_id", "query_id")
    keys = ["server_id", "query_id"]
    freq = (
        durations.join(plans, ["server_id", "plan_id"])
        .groupBy(*keys, "value")
        .agg(F.count("*").alias("rows"), F.sum("count_executions").alias("executions"))
    )
    placed = with_rows_below(freq, keys)
    at_median = (F.col("below") + F.col("rows")) * 2 >= F.col("total")
    return (
        placed.groupBy(*keys)
        .agg(
            F.sum("executions").alias("executions"), F.min("value").alias("min_us"),
            F.min(F.when(at_median, F.col("value"))).alias("median_us"), F.max("value").alias("max_us"),
        )
        .withColumns(
            {"max_over_median": ratio("max_us", "median_us", 20, 2), "max_over_min": ratio("max_us", "min_us", 20, 2)}
        )
        .withColumns(
            grade(
                (F.col("max_over_median") > 100, CRITICAL, "very_unstable"),
                (F.col("max_over_median") > 10, ATTENTION, "unstable"),
            )
        )
    )
