"""Time arithmetic: an explicit as_of, and differences that count unit boundaries."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

from fleetgauge.functions.numbers import as_col

UNIT_SECONDS = {"second": 1, "minute": 60, "hour": 3600}


def instant(moment: datetime | int) -> Column:
    """A timestamp literal: a datetime in the session time zone, or microseconds since 1970.

    Folded before the scan. Microseconds do not depend on the driver's time zone, as
    datetimes collected from Spark do.
    """
    if isinstance(moment, int):
        return F.timestamp_micros(F.lit(moment))
    return F.lit(moment.strftime("%Y-%m-%d %H:%M:%S.%f")).cast("timestamp")


def boundaries(unit: str, start, end) -> Column:
    """How many unit boundaries lie between two instants: 10:59 to 11:01 is one hour."""
    start, end = as_col(start), as_col(end)
    if unit == "day":
        return F.datediff(end, start).cast("bigint")
    step = UNIT_SECONDS[unit]
    return F.floor(F.unix_seconds(end) / step) - F.floor(F.unix_seconds(start) / step)


def coded_timestamp(date, time) -> Column:
    """A timestamp from integers coded yyyymmdd and hhmmss."""
    text = F.concat(as_col(date).cast("string"), F.lpad(as_col(time).cast("string"), 6, "0"))
    return F.to_timestamp(text, "yyyyMMddHHmmss")
