from __future__ import annotations

from datetime import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from fleetgauge.functions.numbers import idiv, percent, ratio
from fleetgauge.functions.severity import ATTENTION, CRITICAL, grade
from fleetgauge.functions.text import contains_any, quote_name, statement_slice, strip_brackets
from fleetgauge.functions.timeunits import boundaries, coded_timestamp, instant
from fleetgauge.functions.waits import IDLE_FULL, IDLE_PATTERNS, active_waits, cause, next_report


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(
    "unit,start,end,expected",
    [
        ("hour", datetime(2024, 1, 1, 10, 59), datetime(2024, 1, 1, 11, 1), 1),
        ("hour", datetime(2024, 1, 1, 10, 0), datetime(2024, 1, 1, 10, 59, 59), 0),
        ("minute", datetime(2024, 1, 1, 10, 0, 59), datetime(2024, 1, 1, 10, 1), 1),
        ("second", datetime(2024, 1, 1, 0, 0, 0, 900000), datetime(2024, 1, 1, 0, 0, 1, 100000), 1),
        ("day", datetime(2024, 1, 1, 23, 59), datetime(2024, 1, 2, 0, 1), 1),
        ("hour", datetime(2024, 1, 1, 11, 1), datetime(2024, 1, 1, 10, 59), -1),
    ],
)
def test_differences_count_boundaries(spark, unit, start, end, expected):
    assert value(spark, boundaries(unit, instant(start), instant(end))) == expected


def test_coded_timestamp_pads_the_time(spark):
    assert value(spark, coded_timestamp(F.lit(20240130), F.lit(90507))) == datetime(2024, 1, 30, 9, 5, 7)


@pytest.mark.parametrize("num,den,expected", [(7, 2, 3), (-7, 2, -3), (7, 0, None)])
def test_integer_division_truncates(spark, num, den, expected):
    assert value(spark, idiv(F.lit(num), F.lit(den))) == expected


def test_ratio_rounds_half_up_and_guards_zero(spark):
    assert value(spark, ratio(F.lit(1), F.lit(8), 10, 2)) == Decimal("0.13")
    assert value(spark, percent(F.lit(1), F.lit(3))) == Decimal("33.33")
    assert value(spark, percent(F.lit(1), F.lit(0))) is None


def test_first_rung_wins_and_null_does_not_match(spark):
    rows = spark.createDataFrame([(5,), (15,), (None,)], "v int")
    rungs = ((F.col("v") > 10, CRITICAL, "high"), (F.col("v") > 1, ATTENTION, "some"))
    got = {r["v"]: (r["severity"], r["reason"]) for r in rows.withColumns(grade(*rungs)).collect()}
    assert got == {5: ("ATTENTION", "some"), 15: ("CRITICAL", "high"), None: ("OK", "ok")}


def test_text_helpers(spark):
    assert value(spark, quote_name(F.lit("a]b"))) == "[a]]b]"
    assert value(spark, strip_brackets(F.lit("[a], [b]"))) == "a, b"
    assert value(spark, contains_any(F.lit("select * from Items"), ["ITEMS", "x"])) is True


@pytest.mark.parametrize("start,end,expected", [(0, -1, "select 1"), (0, 10, "select"), (14, -1, "1"), (4, 8, "lec")])
def test_statement_slice_uses_byte_offsets(spark, start, end, expected):
    assert value(spark, statement_slice(F.lit("select 1"), F.lit(start), F.lit(end))) == expected


def test_wait_vocabulary(spark):
    assert len(IDLE_FULL) == 31
    waits = spark.createDataFrame([(w,) for w in ("sleep_x", "LCK_M_X", "LCKXMXX", "HADR_WORK_QUEUE", "WAITFOR")], "wait_type string")
    kept = {r[0] for r in waits.where(active_waits((), IDLE_PATTERNS)).collect()}
    assert kept == {"LCK_M_X", "LCKXMXX", "WAITFOR"}
    causes = {r[0]: r[1] for r in waits.select("wait_type", cause()).collect()}
    assert causes["LCK_M_X"] == causes["LCKXMXX"] == "blocking"  # _ is a wildcard
    assert value(spark, cause(F.lit("CXSYNC_CONSUMER"))) == "parallelism"
    assert value(spark, cause(F.lit("CXSYNC_CONSUMER"), extended=False)) == "look_up"
    assert value(spark, next_report(F.lit("WRITELOG"))) == "file_latency"
