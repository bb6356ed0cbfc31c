"""What several test modules of the reports share; conftest.py is for fixtures only."""

from __future__ import annotations

SMALL = "/root/testdata/sf0.001"


def graded(df, key: str, field: str = "reason") -> dict:
    return {r[key]: r[field] for r in df.collect()}
