"""Every registered report against its SQL, on the smallest data."""

from __future__ import annotations

import pytest
from compare import compare, connect
from report_helpers import SMALL

from __spark_entry__ import entry
from fleetgauge.oracles.registry import ORACLES
from fleetgauge.plans.registry import queries

QUERIES = queries()


@pytest.fixture(scope="module")
def con():
    return connect(SMALL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_matches_sql(spark, con, name):
    message, _ = compare(spark, con, name, QUERIES[name], ORACLES[name], SMALL)
    assert message is None


def test_every_report_has_sql():
    assert set(QUERIES) == set(ORACLES)


def test_entry_has_rows(spark):
    assert not entry(spark).isEmpty()
