"""Compaction of collector logs: the small files of closed dates become few, clustered ones.

A log is a folder of ``dt=<date>/batch_id=<n>``. Compacting writes the rows of closed dates
anew under ``_compacted/<id>/dt=<date>`` and then commits a manifest, a small file that says
which batches of which dates are replaced by which folder. Readers follow the newest
manifest: a date is read from its replacement, and batches that the manifest does not know
(of open dates, or late ones) from where they landed. Until the manifest is committed
(one atomic rename) nothing has changed for a reader; replaced files stay until
`drop_replaced` takes them away, so that a reader that began before finds its files.

Rewritten rows are sorted along a space-filling curve over chosen columns, and Parquet
keeps Bloom filters of these, so that an equality on one of them skips row groups.
"""

from __future__ import annotations

import json
import uuid
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BITS = 16
#: Rows of one file and bytes of one row group of rewritten dates.
FILE_ROWS, GROUP_BYTES = 2_000_000, 16 << 20


class Folder:
    """The file system of a path, as Spark sees it."""

    def __init__(self, spark: SparkSession, path: str):
        self._jvm = spark._jvm
        self.path = path.rstrip("/")
        self._root = self._jvm.org.apache.hadoop.fs.Path(self.path)
        self._fs = self._root.getFileSystem(spark._jsc.hadoopConfiguration())

    def at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def names(self, name: str = "") -> list[str]:
        place = self.at(name) if name else self._root
        return sorted(s.getPath().getName() for s in self._fs.listStatus(place)) if self._fs.exists(place) else []

    def read(self, name: str) -> str:
        stream = self._fs.open(self.at(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def commit(self, name: str, text: str) -> None:
        """Write a file under another name and rename it: it is there whole or not at all, and never replaced."""
        place, draft = self.at(name), self.at(f"{name}.{uuid.uuid4().hex}.draft")
        out = self._fs.create(draft)
        out.write(bytearray(text.encode()))
        out.close()
        if self._fs.exists(place) or not self._fs.rename(draft, place):
            self._fs.delete(draft, False)
            raise RuntimeError(f"another compaction has committed {name}")

    def remove(self, name: str) -> None:
        self._fs.delete(self.at(name), True)


def manifest(folder: Folder) -> tuple[int, dict[str, dict]]:
    """Number and content of the newest manifest: for each date the replacing folder and the batches it holds."""
    known = [n for n in folder.names("_manifest") if n.endswith(".json")]
    return (int(known[-1][:-5]), json.loads(folder.read(f"_manifest/{known[-1]}"))) if known else (0, {})


def landed(folder: Folder) -> dict[str, list[str]]:
    """The batches of each date that lie where they landed."""
    return {
        d[3:]: [b[9:] for b in folder.names(d) if b.startswith("batch_id=")] for d in folder.names() if d.startswith("dt=")
    }


def read_compacted(spark: SparkSession, path: str) -> DataFrame:
    """All rows of a log, each once: replaced dates from their replacement, other batches from where they landed."""
    folder = Folder(spark, path)
    _, days = manifest(folder)
    if not days:
        return spark.read.parquet(path)
    fresh = [
        f"{path}/dt={d}/batch_id={b}" for d, batches in landed(folder).items() for b in batches if b not in days.get(d, {"batches": ()})["batches"]
    ]
    parts = [spark.read.option("basePath", path).parquet(*fresh)] if fresh else []
    for place in sorted({x["folder"] for x in days.values()}):
        own = [f"{path}/{place}/dt={d}" for d, x in days.items() if x["folder"] == place]
        parts.append(spark.read.option("basePath", f"{path}/{place}").parquet(*own))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part.select(*out.columns))
    return out


def along_curve(rows: DataFrame, columns) -> Column:
    """The place of a row on a Z-order curve: the bits of the columns' places between their ends, interleaved."""
    ends = rows.agg(*[f(F.xxhash64(c) if t == "string" else F.col(c).cast("double")).alias(f"{c}_{n}")
                      for c, t in rows.select(*columns).dtypes for n, f in (("low", F.min), ("high", F.max))]).first()
    z = F.lit(0).cast("bigint")
    for k, (c, t) in enumerate(rows.select(*columns).dtypes):
        low, high = (float(ends[f"{c}_{n}"] or 0) for n in ("low", "high"))
        value = F.xxhash64(c) if t == "string" else F.col(c).cast("double")
        place = F.coalesce(((value - low) / ((high - low) or 1.0) * ((1 << BITS) - 1)).cast("bigint"), F.lit(0))
        for bit in range(BITS):
            z = z + F.shiftleft(F.shiftright(place, bit).bitwiseAND(F.lit(1)), bit * len(columns) + k)
    return z


def write_clustered(rows: DataFrame, path: str, columns, files: int, group_bytes: int = GROUP_BYTES) -> None:
    """Rows by date, along the curve of the columns, with Bloom filters of these."""
    writer = rows.repartitionByRange(files, "dt", along_curve(rows, columns)).sortWithinPartitions("dt", along_curve(rows, columns)).write.partitionBy("dt")
    writer = writer.option("parquet.block.size", str(group_bytes))
    for c in columns:
        writer = writer.option(f"parquet.bloom.filter.enabled#{c}", "true")
    writer.parquet(path)


def compact(spark: SparkSession, path: str, before: date, columns=("server_id",), file_rows: int = FILE_ROWS, group_bytes: int = GROUP_BYTES) -> list[str]:
    """Rewrite the dates before ``before`` that have batches outside the manifest; the dates rewritten."""
    folder = Folder(spark, path)
    number, days = manifest(folder)
    closed = {d: b for d, b in landed(folder).items() if d < before.isoformat()}
    changed = sorted(d for d, b in closed.items() if set(b) - set(days.get(d, {"batches": ()})["batches"]))
    if not changed:
        return []
    rows = read_compacted(spark, path).where(F.col("dt").cast("string").isin(*changed))
    target = f"_compacted/{uuid.uuid4().hex}"
    write_clustered(rows, f"{path}/{target}", list(columns), max(1, -(-rows.count() // file_rows)), group_bytes)
    days |= {d: {"folder": target, "batches": sorted({*closed[d], *days.get(d, {"batches": ()})["batches"]})} for d in changed}
    folder.commit(f"_manifest/{number + 1:012d}.json", json.dumps(days))
    return changed


def drop_replaced(spark: SparkSession, path: str) -> None:
    """Take away batches and folders that the newest manifest has replaced; for a time at which no reader is older than it."""
    folder = Folder(spark, path)
    _, days = manifest(folder)
    for d, batches in landed(folder).items():
        for b in batches:
            if b in days.get(d, {"batches": ()})["batches"]:
                folder.remove(f"dt={d}/batch_id={b}")
        if not folder.names(f"dt={d}"):
            folder.remove(f"dt={d}")
    used = {x["folder"] for x in days.values()}
    for name in folder.names("_compacted"):
        if f"_compacted/{name}" not in used:
            folder.remove(f"_compacted/{name}")
