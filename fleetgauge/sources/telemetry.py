"""Access to telemetry tables, whatever they are read from."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetgauge.sources.base_tables import read_base
from fleetgauge.sources.derived import DERIVED, base_tables_of
from fleetgauge.sources.schemas import EXPORTED_NAMES, EXPORTED_TYPES, HANDLE, TELEMETRY_SCHEMAS

SNAPSHOT_KEY = ("server_id", "snapshot_ts")


def snapshot_keys(df: DataFrame) -> list[str]:
    """The columns that name one server, or one snapshot of one server."""
    return [c for c in SNAPSHOT_KEY if c in df.columns]


def shared_keys(left: DataFrame, right: DataFrame) -> list[str]:
    """The snapshot columns that both sides have: tables of one export meet within their snapshot."""
    return [c for c in snapshot_keys(left) if c in right.columns]


def meet(left: DataFrame, right: DataFrame, on, how: str = "inner") -> DataFrame:
    """Join on the snapshot columns that both sides have, and on others; a missing snapshot time meets a missing one."""
    keys = [*shared_keys(left, right), *on]
    other = right.select(*[F.col(c).alias(f"_{c}" if c in keys else c) for c in right.columns])
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) if k == "snapshot_ts" else F.col(k) == F.col(f"_{k}") for k in keys]
    return left.join(other, reduce(Column.__and__, same), how).drop(*[f"_{k}" for k in keys])


def since_date(log: DataFrame, since: datetime) -> DataFrame:
    """Leave out a landed log's date partitions before an instant; a log without them stays as it is.

    Logs are partitioned by the date of collection, which is never before the rows' own time.
    """
    return log.where(F.col("dt") >= F.lit(since.date())) if "dt" in log.columns else log


def _as_declared(table: str, name: str, kind: str | None, binary: bool) -> Column:
    exported = EXPORTED_NAMES.get((table, name), name)
    value = F.col(exported)
    if kind == HANDLE:
        value = F.hex(value) if binary else F.upper(F.regexp_replace(value, "^0[xX]", ""))
    elif exported != name:  # percent as tenths of a percent
        value = value * 10
    return value.alias(name)


class Telemetry:
    """Named telemetry tables as lazily built DataFrames."""

    def __init__(self, spark: SparkSession, load: Callable[[str], DataFrame]):
        self.spark = spark
        self._load = load
        self._tables: dict[str, DataFrame] = {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._tables:
            self._tables[name] = self._load(name)
        return self._tables[name]

    def replaced(self, **tables: DataFrame) -> "Telemetry":
        """The same telemetry with some tables swapped."""
        other = Telemetry(self.spark, self.__getitem__)
        other._tables.update(tables)
        return other

    @classmethod
    def from_files(cls, spark: SparkSession, root: str, file_format: str = "parquet") -> "Telemetry":
        """Exported tables under ``root/<table>``, read with declared schemas."""

        def load(name: str) -> DataFrame:
            schema = TELEMETRY_SCHEMAS[name]
            return spark.read.schema(schema).format(file_format).load(f"{root}/{name}")

        return cls(spark, load)

    @classmethod
    def from_exports(cls, spark: SparkSession, root: str, file_format: str = "parquet") -> "Telemetry":
        """Tables as a live server exports them: binary handles, float averages and costs, fragmentation in percent.

        Handles become hexadecimal text, by which tables join as before; floats stay floats, so that
        ladders compare what the server reported, and reports round as they always do.
        """

        def load(name: str) -> DataFrame:
            kinds = EXPORTED_TYPES.get(name, {})
            declared = spark.createDataFrame([], TELEMETRY_SCHEMAS[name]).schema
            binary = file_format in ("parquet", "orc", "avro")
            schema = ", ".join(
                f"{EXPORTED_NAMES.get((name, f.name), f.name)} "
                + {None: f.dataType.simpleString(), HANDLE: "binary" if binary else "string"}.get(kinds.get(f.name), kinds.get(f.name) or "")
                for f in declared
            )
            rows = spark.read.schema(schema).format(file_format).load(f"{root}/{name}")
            return rows.select(*[_as_declared(name, f.name, kinds.get(f.name), binary) for f in declared])

        return cls(spark, load)

    @staticmethod
    def stream(spark: SparkSession, root: str, name: str, file_format: str = "parquet", **options) -> DataFrame:
        """A table's landing folder ``root/<table>`` as a stream, with its declared schema."""
        reader = spark.readStream.schema(TELEMETRY_SCHEMAS[name]).options(**options)
        return reader.format(file_format).load(f"{root}/{name}")

    @classmethod
    def from_catalog(cls, spark: SparkSession, prefix: str = "") -> "Telemetry":
        """Catalog tables, bucketed ones included: ``prefix`` is a database with its dot,
        or any other leading part of the names."""
        return cls(spark, lambda name: spark.table(f"{prefix}{name}"))

    @classmethod
    def from_frames(cls, spark: SparkSession, **tables: DataFrame) -> "Telemetry":
        return cls(spark, tables.__getitem__)

    @classmethod
    def derived(cls, spark: SparkSession, folder: str, **base: DataFrame) -> "Telemetry":
        """Telemetry derived from star-schema files (or from the given base frames)."""

        def load(name: str) -> DataFrame:
            statement = DERIVED[name]
            frames = {
                b: base[b] if b in base else read_base(spark, folder, b)
                for b in base_tables_of(statement)
            }
            return spark.sql(statement, **frames)

        return cls(spark, load)
