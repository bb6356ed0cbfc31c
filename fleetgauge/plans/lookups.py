"""Name and text lookups shared by the reports.

Dimensions grow with the fleet, so none is force-broadcast: Spark broadcasts one when
its size is under the threshold and otherwise shuffles both sides, where AQE splits
the partitions of a hot key. Reports rank first and look up after wherever they can.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetgauge.sources.telemetry import Telemetry


def having_text(rows: DataFrame, t: Telemetry) -> DataFrame:
    """Keep rows whose statement text is known, without carrying the text along."""
    return rows.join(t["sql_text"].select("sql_handle"), "sql_handle", "left_semi")


def with_text(
    rows: DataFrame, t: Telemetry, length: int | None = None, name: str = "text",
    handle: str = "sql_handle", how: str = "inner",
) -> DataFrame:
    text = F.col("text") if length is None else F.substring("text", 1, length)
    texts = t["sql_text"].select(F.col("sql_handle").alias(handle), text.alias(name))
    return rows.join(texts, handle, how)


def with_database(rows: DataFrame, t: Telemetry, how: str = "left") -> DataFrame:
    """Add database_name by (server_id, database_id)."""
    names = t["database_dim"].select("server_id", "database_id", F.col("name").alias("database_name"))
    return rows.join(names, ["server_id", "database_id"], how)
