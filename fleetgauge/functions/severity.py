"""Severity ladders: ordered rungs, first match wins."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

OK = "OK"
ATTENTION = "ATTENTION"
CRITICAL = "CRITICAL"

Rung = tuple[Column, str, str]


def ladder(rungs: tuple[Rung, ...], otherwise: str, pick: int) -> Column:
    first, *rest = rungs
    chain = F.when(first[0], F.lit(first[pick]))
    for rung in rest:
        chain = chain.when(rung[0], F.lit(rung[pick]))
    return chain.otherwise(F.lit(otherwise))


def grade(
    *rungs: Rung,
    otherwise: tuple[str, str] = (OK, "ok"),
    names: tuple[str, str] = ("severity", "reason"),
) -> dict[str, Column]:
    """Columns for ``withColumns``: the severity and the reason code of a row.

    A rung whose predicate is NULL does not match, as in a searched CASE.
    """
    return {
        names[0]: ladder(rungs, otherwise[0], 1),
        names[1]: ladder(rungs, otherwise[1], 2),
    }
