"""Operators with SQL, whole tables on both engines."""

from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from compare import compare, connect  # noqa: E402

from fleetgauge.llm.registry import oracle_sql, queries  # noqa: E402

FOLDER = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_matches_sql(shipped, name):
    message, rows = compare(shipped, connect(FOLDER), name, queries()[name], oracle_sql()[name], FOLDER)
    assert message is None and rows == 1000
