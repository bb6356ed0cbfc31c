"""Integer and decimal arithmetic with the report semantics."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_col(value) -> Column:
    if isinstance(value, Column):
        return value
    return F.col(value) if isinstance(value, str) else F.lit(value)


def idiv(num, den) -> Column:
    """Integer division that truncates toward zero; NULL when den is 0."""
    den = as_col(den) if isinstance(den, int) else F.nullif(as_col(den), F.lit(0))
    return F.call_function("div", as_col(num).cast("bigint"), den.cast("bigint"))


def ratio(num, den, precision: int, scale: int, factor: int = 1) -> Column:
    """factor * num / den as DECIMAL(precision, scale), half up; NULL when den is 0."""
    num = as_col(num).cast("decimal(20,0)") * F.lit(factor)
    den = F.nullif(as_col(den), F.lit(0)).cast("decimal(20,0)")
    return (num / den).cast(f"decimal({precision},{scale})")


def percent(num, den, precision: int = 5, scale: int = 2) -> Column:
    return ratio(num, den, precision, scale, factor=100)


def zero_if_null(value) -> Column:
    return F.coalesce(as_col(value), F.lit(0))


def count_where(predicate: Column) -> Column:
    return F.count_if(predicate)


def pages_to_mb(pages) -> Column:
    """8 KB pages to whole MB."""
    return idiv(as_col(pages) * 8, 1024)
