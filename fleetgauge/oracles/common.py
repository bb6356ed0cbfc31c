"""Building blocks of the ANSI SQL the reports are checked against."""

from __future__ import annotations

import re

from fleetgauge.sources.derived import DERIVED

EVENTS_NOW = "TIMESTAMP '2024-01-31 00:00:00'"
ORDERS_NOW = "TIMESTAMP '2001-08-02 00:00:00'"


def inline(name: str) -> str:
    return re.sub(r"\{(\w+)\}", r"\1", DERIVED[name]).strip()


def sql(body: str, *tables: str) -> str:
    """A statement with the derived tables it reads in front, as CTEs."""
    ctes = [f"{t} AS ({inline(t)})" for t in tables]
    body = body.strip()
    if body.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {', '.join([*ctes, body[15:]])}"
    if body.upper().startswith("WITH "):
        return f"WITH {', '.join([*ctes, body[5:]])}"
    return f"WITH {', '.join(ctes)} {body}" if ctes else body


def case(*rungs: tuple[str, str, str], otherwise=("OK", "ok"), names=("severity", "reason")) -> str:
    """Two CASE expressions: severity and reason."""
    out = []
    for pick, name, rest in ((1, names[0], otherwise[0]), (2, names[1], otherwise[1])):
        whens = " ".join(f"WHEN {r[0]} THEN '{r[pick]}'" for r in rungs)
        out.append(f"CASE {whens} ELSE '{rest}' END AS {name}")
    return ", ".join(out)


def idiv(num: str, den) -> str:
    return f"(CAST({num} AS BIGINT) // NULLIF(CAST({den} AS BIGINT), 0))"


def rdiv(num: str, den: str, digits: int, factor: int = 1) -> str:
    """factor * num / den rounded half away from zero, in exact integer arithmetic."""
    n = f"(CAST({num} AS HUGEINT) * {factor * 10**digits})"
    d = f"NULLIF(CAST({den} AS HUGEINT), 0)"
    whole = f"((2 * abs({n}) + abs({d})) // (2 * abs({d}))) * sign({n}) * sign({d})"
    return f"(CAST({whole} AS DOUBLE) / {10**digits})"


def pct(num: str, den: str, digits: int = 2) -> str:
    return rdiv(num, den, digits, factor=100)


def mb(pages: str) -> str:
    return idiv(f"({pages}) * 8", 1024)


def big(expr: str) -> str:
    return f"CAST({expr} AS BIGINT)"


def hours(start: str, end: str) -> str:
    return f"date_diff('hour', {start}, {end})"


def days(start: str, end: str) -> str:
    return f"date_diff('day', CAST({start} AS DATE), CAST({end} AS DATE))"


def exports(table: str, counters: tuple[str, ...], readings: tuple[tuple[int, int], ...]) -> str:
    """A table as exported on several days of January 2024: (day, times the counts)."""
    values = ", ".join(f"(TIMESTAMP '2024-01-{day:02d} 00:00:00', {n})" for day, n in readings)
    scaled = ", ".join(f"{c} * x.n AS {c}" for c in counters)
    return f"(SELECT t.* REPLACE ({scaled}), x.ts AS snapshot_ts FROM {table} t CROSS JOIN (VALUES {values}) x(ts, n))"


#: A capture was taken on the 10th and the 20th, readings on the 15th, 20th and 25th.
CAPTURES, READINGS = ((10, 1), (20, 2)), ((15, 2), (20, 3), (25, 4))
