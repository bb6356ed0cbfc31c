"""Helpers shared by the text operators."""

from __future__ import annotations

import os
import shutil
import tempfile
from collections.abc import Callable
from pathlib import Path

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetgauge.session import work_path

#: Bytes of one Arrow batch that goes to a Python worker, and rows of one.
BATCH_BYTES, BATCH_ROWS = 16 << 20, 4096


def ready(spark: SparkSession) -> None:
    """What registered queries and the pipeline need of a session; operators leave it as it is.

    Bounds what a Python worker holds at once by bytes, so that long texts fit, and hands
    this package to the workers where their PYTHONPATH does not name it.
    """
    package = Path(__file__).resolve().parents[1]
    named = str(package.parent) in os.environ.get("PYTHONPATH", "").split(os.pathsep)
    if not named and package.is_dir() and not getattr(spark.sparkContext, "_fleetgauge_shipped", False):
        # a file that Spark itself hands to every executor; it may lie on the driver's disk
        into = tempfile.mkdtemp(prefix="fleetgauge-code-")
        spark.sparkContext.addPyFile(shutil.make_archive(f"{into}/fleetgauge", "zip", package.parent, package.name))
        spark.sparkContext._fleetgauge_shipped = True
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def shingle_hashes(body: bytes | None, size: int) -> np.ndarray:
    """Hashes of the text's word shingles of this size, in their order; fewer words are one shingle, none are none."""
    words = (body or b"").translate(LOWER).split()
    if not words:
        return np.empty(0, np.uint64)
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= size:
        return np.array([digest(joined, 42)], dtype=np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths).tolist()
    return np.fromiter((digest(joined[a:b], 42) for a, b in zip(starts, ends[size - 1 :].tolist())), np.uint64, len(words) - size + 1)


def over_half(hashes: np.ndarray) -> int:
    """The 64 bits that are set in over half of the hashes, unsigned."""
    ones = np.zeros(64, dtype=np.int64)
    for k in range(0, len(hashes), 1 << 16):
        part = hashes[k : k + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def columns(df: DataFrame, names: list[str] | None = None) -> list:
    return [F.col(quoted(c)) for c in (df.columns if names is None else names)]


#: Files of a saved table that is known to be small.
FEW = 16


def saved(df: DataFrame, name: str, small: bool = False) -> DataFrame:
    """Write a table to the shared folder and read it back.

    It cuts lineage, is computed once, and a lost executor costs a reread at most. A table
    of which a few tasks can hold every row goes to `FEW` files.
    """
    path = work_path(df.sparkSession, name)
    (df.coalesce(FEW) if small else df).write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Bits of a key filter: sixteen for each key, and no fewer or more than these.
FEWEST_BITS, MOST_BITS = 1 << 16, 1 << 26


class KeyFilter:
    """A set of 64-bit hashes as one bit each, for tasks: it holds all of them, and few others up to some millions of keys.

    Its size follows the number of keys and ends at 8 MB, beyond which it lets more others
    through. An exact join has to follow it.
    """

    def __init__(self, keys: DataFrame, column: str):
        distinct = keys.select(column).distinct()
        bits = min(MOST_BITS, max(FEWEST_BITS, 1 << (16 * distinct.count()).bit_length()))
        place = F.pmod(F.col(column), F.lit(bits))
        words = distinct.groupBy(F.floor(place / 64).cast("int").alias("word")).agg(
            F.bit_or(F.expr(f"shiftleft(1L, CAST(pmod(`{column}`, 64) AS INT))")).alias("bits")
        ).toArrow()  # bits / 64 rows at most
        self.mask, self.words = bits - 1, np.zeros(bits // 64, np.uint64)
        self.words[words.column(0).to_numpy()] = words.column(1).to_numpy().view(np.uint64)

    def holds(self, keys: np.ndarray) -> np.ndarray:
        at = keys.view(np.uint64) & np.uint64(self.mask)
        return (self.words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)

    def __contains__(self, key: int) -> bool:
        at = key & self.mask
        return bool(int(self.words[at >> 6]) >> (at & 63) & 1)


def packed(docs: DataFrame, carry: list[str] | None = None, text: str = "text") -> DataFrame:
    """Columns `row` (a struct of the carried columns) and `body` (the UTF-8 bytes of the text).

    The struct keeps the documents' own column names out of the way of an operator's.
    """
    return docs.select(F.struct(*columns(docs, carry)).alias("row"), F.col(quoted(text)).cast("binary").alias("body"))


def map_bodies(
    docs: DataFrame,
    work: Callable[[list[bytes]], list],
    fields: list[T.StructField],
    carry: list[str] | None = None,
    text: str = "text",
) -> DataFrame:
    """`row` and the fields that `work` makes of each batch of texts (None where the text is null).

    `work` is called with a list of bytes and returns one list or Arrow array for each field.
    """
    source = packed(docs, carry, text)
    schema = T.StructType([source.schema["row"], *fields])
    names = [f.name for f in schema]

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                made = work(batch.column(1).to_pylist())
                kinds = [to_arrow(f.dataType) for f in fields]
                arrays = [x if isinstance(x, (pa.Array, pa.ChunkedArray)) else pa.array(x, k) for x, k in zip(made, kinds)]
                yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], names=names)

    return source.mapInArrow(run, schema)


SIMPLE = {
    "bigint": (T.LongType(), pa.int64()), "int": (T.IntegerType(), pa.int32()), "string": (T.StringType(), pa.string()),
    "double": (T.DoubleType(), pa.float64()), "boolean": (T.BooleanType(), pa.bool_()), "binary": (T.BinaryType(), pa.binary()),
}


def to_arrow(kind: T.DataType) -> pa.DataType:
    if isinstance(kind, T.ArrayType):
        return pa.list_(to_arrow(kind.elementType))
    if isinstance(kind, T.StructType):
        return pa.struct([pa.field(f.name, to_arrow(f.dataType)) for f in kind])
    return SIMPLE[kind.simpleString()][1]


def field(name: str, kind: str | T.DataType) -> T.StructField:
    return T.StructField(name, kind if isinstance(kind, T.DataType) else SIMPLE[kind][0])


def strings() -> T.ArrayType:
    return T.ArrayType(T.StringType())


def structs(**kinds) -> T.ArrayType:
    return T.ArrayType(T.StructType([field(n, k) for n, k in kinds.items()]))


def unpacked(df: DataFrame, *more) -> DataFrame:
    """The carried columns again, then the named ones."""
    names = df.schema["row"].dataType.names
    return df.select(*[F.col(f"row.{quoted(c)}").alias(c) for c in names], *more)


def with_text(rows: DataFrame, new: str, text: str = "text") -> DataFrame:
    """The carried columns with the text replaced by the column `new`.

    A column n_chars that held the length of the old text holds that of the new one.
    """
    old = F.col(f"row.{quoted(text)}")

    def column(name: str):
        value = F.col(f"row.{quoted(name)}")
        if name == text:
            return F.col(new).alias(name)
        if name == "n_chars":
            return F.when(value == F.length(old), F.length(new).cast("bigint")).otherwise(value).cast(rows.schema["row"].dataType["n_chars"].dataType).alias(name)
        return value.alias(name)

    return rows.select(*map(column, rows.schema["row"].dataType.names))
