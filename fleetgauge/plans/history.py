"""Event histories: maintenance, backups, integrity checks, jobs, error log."""

from __future__ import annotations

from datetime import datetime, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetgauge.functions.numbers import count_where, idiv, percent, ratio
from fleetgauge.functions.severity import ATTENTION, CRITICAL, grade
from fleetgauge.functions.timeunits import boundaries, coded_timestamp, instant
from fleetgauge.operators.previous import with_previous
from fleetgauge.operators.topk import top_per
from fleetgauge.sources.telemetry import Telemetry, since_date

BYTES_PER_GB = 1024**3
RUN_RESULTS = {0: "FAILED", 1: "OK", 2: "RETRY", 3: "CANCELLED"}


def maintenance_log(t: Telemetry, top: int = 100) -> DataFrame:
    """The latest maintenance commands of each server."""
    log = t["command_log"].select(
        "server_id", "command_id", "database_name", "table_name", "index_name", "command_type",
        "start_time", "end_time", boundaries("second", "start_time", "end_time").alias("seconds"),
        "error_number", "error_message",
    )
    return top_per(log, ["server_id"], [F.desc("start_time"), "command_id"], top).withColumns(
        grade(
            (F.col("error_number").isNotNull(), CRITICAL, "error"),
            (F.col("seconds") > 3600, ATTENTION, "over_1h"),
        )
    )


def backup_age(t: Telemetry, as_of: datetime) -> DataFrame:
    def last(kind: str) -> Column:
        return F.max(F.when(F.col("type") == kind, F.col("backup_finish_date")))

    return (
        t["backupset"]
        .groupBy("server_id", "database_name")
        .agg(last("D").alias("last_full"), last("I").alias("last_differential"), last("L").alias("last_log"))
        .withColumn("hours_since_full", boundaries("hour", "last_full", instant(as_of)))
        .withColumns(
            grade(
                (F.col("last_full").isNull(), CRITICAL, "never_full"),
                (F.col("hours_since_full") > 48, CRITICAL, "full_over_48h"),
                (F.col("hours_since_full") > 24, ATTENTION, "full_over_24h"),
            )
        )
    )


def integrity_age(t: Telemetry, as_of: datetime) -> DataFrame:
    return (
        t["database_dim"]
        .where((F.col("state_desc") == "ONLINE") & (F.col("database_id") > 4))
        .select(
            "server_id", "name", F.col("last_good_check_time").alias("last_check"),
            boundaries("day", "last_good_check_time", instant(as_of)).alias("days_since_check"),
        )
        .withColumns(
            grade(
                (F.col("last_check").isNull(), CRITICAL, "never_checked"),
                (F.col("days_since_check") > 30, CRITICAL, "over_30d"),
                (F.col("days_since_check") > 7, ATTENTION, "over_7d"),
            )
        )
    )


def job_failures(t: Telemetry, as_of: datetime, hours: int = 24) -> DataFrame:
    """Failed, retried and cancelled job runs of the last hours.

    The coded date is compared first: it prunes the history by plain integers.
    """
    since = as_of - timedelta(hours=hours)
    history = t["job_history"].where(
        F.col("run_status").isin(0, 2, 3) & (F.col("run_date") >= int(since.strftime("%Y%m%d")))
    )
    history = history.withColumn("run_time_at", coded_timestamp("run_date", "run_time")).where(
        F.col("run_time_at") >= instant(since)
    )
    status = F.col("run_status")
    result = F.create_map(*[F.lit(v) for pair in RUN_RESULTS.items() for v in pair])[status]
    return (
        history.join(t["job_dim"].select("server_id", "job_id", "name"), ["server_id", "job_id"])
        .select(
            "server_id", "instance_id", F.col("name").alias("job"), "step_name",
            F.col("run_time_at").alias("executed_at"), result.alias("result"),
            F.substring("message", 1, 500).alias("message"),
            *[
                c.alias(n)
                for n, c in grade(
                    (status == 0, CRITICAL, "job_failed"),
                    (status == 2, ATTENTION, "job_retried"),
                    (status == 3, ATTENTION, "job_cancelled"),
                ).items()
            ],
        )
    )


def _full_backups(t: Telemetry, as_of: datetime, months: int) -> DataFrame:
    since = instant(as_of) - F.make_ym_interval(F.lit(0), F.lit(months))
    return t["backupset"].where((F.col("type") == "D") & (F.col("backup_finish_date") >= since))


def backup_growth(t: Telemetry, as_of: datetime, months: int = 6) -> DataFrame:
    """Full backups with their growth over the one before."""
    rows = with_previous(
        _full_backups(t, as_of, months), ["server_id", "database_name"],
        ["backup_finish_date", "backup_set_id"], F.date_trunc("month", "backup_finish_date"), ["backup_size"],
    )
    growth = F.col("backup_size") - F.col("prev_backup_size")
    saved = F.col("backup_size") - F.col("compressed_backup_size")
    return rows.select(
        "server_id", "database_name", "backup_set_id", "backup_finish_date",
        ratio("backup_size", F.lit(BYTES_PER_GB), 12, 2).alias("backup_gb"),
        ratio("compressed_backup_size", F.lit(BYTES_PER_GB), 12, 2).alias("compressed_gb"),
        percent(saved, "backup_size", 7, 1).alias("compression_pct"),
        ratio(growth, F.lit(BYTES_PER_GB), 12, 2).alias("growth_gb"),
        *[
            c.alias(n)
            for n, c in grade(
                (growth > 10 * BYTES_PER_GB, CRITICAL, "grew_over_10gb"),
                (growth > 5 * BYTES_PER_GB, ATTENTION, "grew_over_5gb"),
            ).items()
        ],
    )


def monthly_size(t: Telemetry, as_of: datetime, months: int = 6) -> DataFrame:
    finished = F.col("backup_finish_date")
    spread = F.col("max_bytes") - F.col("min_bytes")
    return (
        _full_backups(t, as_of, months)
        .groupBy("server_id", "database_name", F.year(finished).alias("year"), F.month(finished).alias("month"))
        .agg(
            F.max("backup_size").alias("max_bytes"), F.min("backup_size").alias("min_bytes"),
            F.count("*").alias("backups"),
        )
        .withColumns(
            grade(
                (spread > 10 * BYTES_PER_GB, CRITICAL, "varied_over_10gb"),
                (spread > 5 * BYTES_PER_GB, ATTENTION, "varied_over_5gb"),
            )
        )
        .select(
            "server_id", "database_name", "year", "month",
            ratio("max_bytes", F.lit(BYTES_PER_GB), 12, 2).alias("max_gb"), "backups",
            ratio(spread, F.lit(BYTES_PER_GB), 12, 2).alias("spread_gb"), "severity", "reason",
        )
    )


def growth_forecast(t: Telemetry, as_of: datetime, capacity_mb: int = 500_000) -> DataFrame:
    """Least-squares growth of the full backups up to ``as_of`` per database, and days from then until capacity.

    Days are counted from ``as_of``, so the line's value at zero is the size to expect now;
    a database that is there already has no days left. The sums are exact integers, so the
    result does not depend on the order of rows.
    """
    day = boundaries("day", instant(as_of), "backup_finish_date").cast("decimal(20,0)")
    size = idiv("backup_size", 1024**2).cast("decimal(20,0)")
    known = t["backupset"].where((F.col("type") == "D") & (F.col("backup_finish_date") <= instant(as_of)))
    full = known.select("server_id", "database_name", day.alias("x"), size.alias("y"))
    x, y = F.col("x"), F.col("y")
    sums = full.groupBy("server_id", "database_name").agg(
        F.count("*").alias("backups"), F.sum(x).alias("sx"), F.sum(y).alias("sy"),
        F.sum(x * y).alias("sxy"), F.sum(x * x).alias("sxx"),
    )
    n = F.col("backups").cast("decimal(10,0)")
    rows = sums.withColumns(
        {
            "num": (n * F.col("sxy") - F.col("sx") * F.col("sy")).cast("decimal(38,0)"),
            "den": (n * F.col("sxx") - F.col("sx") * F.col("sx")).cast("decimal(38,0)"),
        }
    )
    slope = F.col("num").cast("double") / F.nullif(F.col("den"), F.lit(0)).cast("double")
    mean = F.col("sy").cast("double") / F.col("backups")
    now = (F.col("sy").cast("double") - slope * F.col("sx").cast("double")) / F.col("backups")
    left = F.greatest(F.ceil((F.lit(capacity_mb) - now) / slope), F.lit(0))
    return rows.select(
        "server_id", "database_name", "backups", slope.alias("mb_per_day"), mean.alias("mean_mb"),
        F.when(slope > 0, left).alias("days_to_capacity"),
    )


#: A step between backups is a level shift if it is over eight usual steps and a tenth of the size.
SHIFT_STEPS, SHIFT_SHARE = 8, 10
PARTNERS = 16


def growth_after_shifts(t: Telemetry, as_of: datetime, capacity_mb: int = 500_000) -> DataFrame:
    """Growth of the full backups since the last level shift per database, and days from ``as_of`` until capacity.

    A purge or a load in the middle of a series bends a least-squares line. Here the series is
    parted where a step is over `SHIFT_STEPS` times the median step and over a
    `SHIFT_SHARE`-th of the size before it. The slope of the last part is the median of the
    slopes between each backup and up to `PARTNERS` others of it, taken by a hash of their
    numbers; with p such pairs its rank among all pairs' slopes is off by more than e with a
    probability of 2 exp(-2 p e^2) at most. The size to expect now is the median of the
    backups' sizes moved along that slope. A series is the backups of one database.
    """
    day = boundaries("day", instant(as_of), "backup_finish_date").cast("bigint")
    size = idiv("backup_size", 1024**2)
    known = t["backupset"].where((F.col("type") == "D") & (F.col("backup_finish_date") <= instant(as_of)))
    key = ["server_id", "database_name"]
    in_time = Window.partitionBy(*key).orderBy("backup_finish_date", "backup_set_id")
    series = known.select(*key, "backup_finish_date", "backup_set_id", day.alias("x"), size.alias("y")).withColumn("step", F.col("y") - F.lag("y").over(in_time))
    middle = lambda of: F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY {of})")
    usual = series.groupBy(*key).agg(middle("abs(step)").alias("usual"))
    before = F.col("y") - F.col("step")
    shift = (F.abs("step") > F.col("usual") * SHIFT_STEPS) & (F.abs("step") * SHIFT_SHARE > F.abs(before))
    parted = series.join(usual, key).withColumn("part", F.sum(F.coalesce(shift, F.lit(False)).cast("int")).over(in_time.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    whole = Window.partitionBy(*key)
    last = parted.withColumn("shifts", F.max("part").over(whole)).where(F.col("part") == F.col("shifts"))
    points = last.select(*key, "shifts", "x", "y", (F.row_number().over(in_time) - 1).alias("i"), F.count("*").over(whole).alias("n"))
    others = F.least(F.col("n") - 1, F.lit(PARTNERS)).cast("int")
    # with few others all are taken, else some by a hash that other engines can follow
    offset = F.when(F.col("n") - 1 <= PARTNERS, F.col("j")).otherwise(F.pmod(F.col("i") * 7919 + F.col("j") * 104729, F.col("n") - 1) + 1)
    asked = points.where("n > 1").withColumn("j", F.explode(F.sequence(F.lit(1), others))).withColumn("other", F.pmod(F.col("i") + offset, "n"))
    partner = points.select(*key, F.col("i").alias("other"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    slopes = asked.join(partner, [*key, "other"]).where("x <> x2").select(*key, ((F.col("y2") - F.col("y")) / (F.col("x2") - F.col("x"))).alias("slope"))
    slope = slopes.groupBy(*key).agg(middle("slope").alias("mb_per_day"))
    # days count backwards from as_of, so that a size moves along the slope by x days
    moved = points.join(slope, key, "left").withColumn("moved", F.col("y") - F.coalesce("mb_per_day", F.lit(0.0)) * F.col("x"))
    rows = moved.groupBy(*key).agg(
        F.max("shifts").cast("bigint").alias("level_shifts"), F.count("*").alias("backups"), F.first("mb_per_day").alias("mb_per_day"), middle("moved").alias("mb_now")
    )
    left = F.greatest(F.ceil((F.lit(capacity_mb) - F.col("mb_now")) / F.col("mb_per_day")), F.lit(0))
    return rows.withColumn("days_to_capacity", F.when(F.col("mb_per_day") > 0, left))


def restart_events(t: Telemetry, phrases=("is starting", "is now ready")) -> DataFrame:
    """Error-log lines that contain one of the phrases, one row per line and phrase.

    Rows carry the server and the time of the event where the log has them (as the text
    reader of error logs gives them). Texts without any of the phrases are left out whole; only the others are split.
    """
    log = t["error_log"]
    wanted = reduce(Column.__or__, [F.contains(F.lower("text"), F.lower(F.lit(p))) for p in phrases])
    known = [c for c in ("server_id", "event_ts") if c in log.columns]
    lines = log.where(wanted).select(
        *known, "log_id", "log_type", F.posexplode(F.split("text", "\n")).alias("line_number", "line")
    )
    hits = F.filter(
        F.array(*[F.lit(p) for p in phrases]),
        lambda p: F.contains(F.lower("line"), F.lower(p)),
    )
    return lines.select(*known, "log_id", "log_type", "line_number", F.explode(hits).alias("phrase"), "line")


def hourly_sessions(t: Telemetry, as_of: datetime, hours: int = 24) -> DataFrame:
    """Hourly history of the collected session log."""
    since = as_of - timedelta(hours=hours)
    log = since_date(t["log_session"], since).where(F.col("snapshot_ts") >= instant(since))
    return (
        log.groupBy(
            "server_id", F.date_trunc("day", "snapshot_ts").alias("day"), F.hour("snapshot_ts").alias("hour")
        )
        .agg(
            F.countDistinct("session_id").alias("sessions"),
            F.max("cpu_time").alias("max_cpu_ms"),
            count_where(F.col("blocking_session_id") > 0).alias("blocked"),
        )
        .withColumns(hourly_ladder())
    )


def hourly_ladder() -> dict[str, Column]:
    return grade(
        (F.col("blocked") > 10, CRITICAL, "over_10_blocked"),
        (F.col("max_cpu_ms") > 300_000, ATTENTION, "cpu_peak"),
        (F.col("sessions") > 100, ATTENTION, "over_100_sessions"),
    )
