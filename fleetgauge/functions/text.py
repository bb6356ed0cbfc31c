"""String helpers: bracket quoting, statement slices, column-list clean-up."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fleetgauge.functions.numbers import as_col


def quote_name(name) -> Column:
    return F.concat(F.lit("["), F.replace(as_col(name), F.lit("]"), F.lit("]]")), F.lit("]"))


def strip_brackets(columns) -> Column:
    return F.translate(as_col(columns), "[]", "")


def statement_slice(text, start_offset, end_offset) -> Column:
    """The running statement inside a batch, from byte offsets into UTF-16 text.

    An end offset of -1 means the end of the batch.
    """
    text, start, end = as_col(text), as_col(start_offset), as_col(end_offset)
    stop = F.when(end == -1, 2 * F.char_length(text)).otherwise(end)
    position = F.call_function("div", start.cast("bigint"), F.lit(2).cast("bigint")) + 1
    length = F.call_function("div", (stop - start).cast("bigint"), F.lit(2).cast("bigint")) + 1
    return F.substring(text, position.cast("int"), length.cast("int"))


def contains_any(text, needles) -> Column:
    """Case-insensitive containment of any of the given strings."""
    needles = list(needles)
    hit = F.contains(F.lower(as_col(text)), F.lit(needles[0].lower()))
    for needle in needles[1:]:
        hit = hit | F.contains(F.lower(as_col(text)), F.lit(needle.lower()))
    return hit
