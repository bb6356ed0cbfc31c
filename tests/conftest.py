from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path[:0] = [str(Path(__file__).resolve().parents[1]), str(Path(__file__).resolve().parent)]

from fleetgauge.session import checkpoint_root, local_session, prepare  # noqa: E402
from fleetgauge.sources.schemas import TELEMETRY_SCHEMAS  # noqa: E402
from fleetgauge.sources.telemetry import Telemetry  # noqa: E402
from report_helpers import SMALL  # noqa: E402

@pytest.fixture(scope="session")
def spark():
    session = prepare(local_session(4, app="tests", memory="4g"))
    checkpoint_root(session)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def telemetry(spark):
    return Telemetry.derived(spark, SMALL)


@pytest.fixture(scope="session")
def make(spark):
    """Telemetry from hand-made rows: make(table=[{column: value}, ...]); missing values are NULL."""

    def frame(table: str, rows: list[dict]):
        schema = spark.createDataFrame([], TELEMETRY_SCHEMAS[table]).schema
        return spark.createDataFrame([tuple(r.get(f, None) for f in schema.names) for r in rows], schema)

    def build(**tables: list[dict]) -> Telemetry:
        return Telemetry.from_frames(spark, **{n: frame(n, r) for n, r in tables.items()})

    return build
