"""Compacted collector logs and error logs of several lines."""

from __future__ import annotations

import random
from collections import Counter
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from fleetgauge.plans import history
from fleetgauge.sources import compaction
from fleetgauge.sources.compaction import compact, drop_replaced, read_compacted, write_clustered
from fleetgauge.sources.error_log import located_lines, read_error_log
from fleetgauge.sources.sinks import write_batch
from fleetgauge.sources.telemetry import Telemetry


def batch(spark, n: int, day: int, size: int = 50):
    ts = datetime(2024, 1, day, 5)
    return spark.createDataFrame([(k % 7, ts, 1000 * n + k, f"text {k}") for k in range(size)], "server_id long, collected_at timestamp, session_id long, wait_type string")


def rows_of(df):
    return Counter((r["server_id"], r["collected_at"], r["session_id"], r["wait_type"], r["dt"], r["batch_id"]) for r in df.collect())


@pytest.fixture
def log(spark, tmp_path):
    path = str(tmp_path / "log_session")
    for n, day in enumerate([1, 1, 2, 2, 3]):
        write_batch(batch(spark, n, day), path, "collected_at", n)
    return path


def test_compaction_keeps_every_row(spark, log):
    before = rows_of(read_compacted(spark, log))
    assert compact(spark, log, date(2024, 1, 3), ["server_id", "session_id"]) == ["2024-01-01", "2024-01-02"]
    assert rows_of(read_compacted(spark, log)) == before and sum(before.values()) == 250
    files = read_compacted(spark, log).inputFiles()
    assert sum("_compacted" in f for f in files) == 2 and all("_compacted" in f or "dt=2024-01-03" in f for f in files)
    assert compact(spark, log, date(2024, 1, 3), ["server_id"]) == []
    drop_replaced(spark, log)
    assert rows_of(read_compacted(spark, log)) == before
    assert rows_of(spark.read.option("basePath", log).parquet(f"{log}/dt=*")) == Counter({k: n for k, n in before.items() if k[4] == date(2024, 1, 3)})


def test_a_compaction_that_dies_changes_nothing(spark, log, monkeypatch):
    """Killed before the manifest is there: readers see what they saw, the next run goes through, and the remains are taken away."""
    before = rows_of(read_compacted(spark, log))

    def dies(self, name, text):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(compaction.Folder, "commit", dies)
        with pytest.raises(KeyboardInterrupt):
            compact(spark, log, date(2024, 1, 3))
    assert rows_of(read_compacted(spark, log)) == before and len(compaction.Folder(spark, log).names("_compacted")) == 1
    reader = read_compacted(spark, log)  # begun before the compaction, read after it
    assert compact(spark, log, date(2024, 1, 3)) and rows_of(reader) == before == rows_of(read_compacted(spark, log))
    drop_replaced(spark, log)
    assert len(compaction.Folder(spark, log).names("_compacted")) == 1 and rows_of(read_compacted(spark, log)) == before


def test_late_batches_of_a_closed_date(spark, log):
    compact(spark, log, date(2024, 1, 4))
    drop_replaced(spark, log)
    write_batch(batch(spark, 9, 2), log, "collected_at", 9)
    want = rows_of(read_compacted(spark, log))
    assert sum(want.values()) == 300
    assert compact(spark, log, date(2024, 1, 4)) == ["2024-01-02"]
    drop_replaced(spark, log)
    assert rows_of(read_compacted(spark, log)) == want


def test_two_compactions_at_once(spark, log):
    """The second to commit fails, and changes nothing."""
    folder = compaction.Folder(spark, log)
    folder.commit("_manifest/000000000001.json", "{}")
    with pytest.raises(RuntimeError, match="another compaction"):
        folder.commit("_manifest/000000000001.json", "{}")
    assert [n for n in folder.names("_manifest") if "draft" in n] == []


def scanned(df) -> int:
    """Rows that the scan of a frame gives, after skipping row groups."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    leaves = plan.collectLeaves()
    return sum(leaves.apply(k).metrics().apply("numOutputRows").value() for k in range(leaves.size()))


def test_clustered_files_are_skipped(spark, tmp_path):
    """An equality on a clustered column reads few row groups: the values that a group holds are close, and its Bloom filter knows the rest."""
    rows = spark.range(200_000).selectExpr("DATE '2024-01-01' AS dt", "id * 7919 % 199999 AS session_id", "id % 50 AS server_id", "concat('h', id * 31 % 5000) AS handle")
    write_clustered(rows, str(tmp_path / "z"), ["server_id", "session_id"], 8, group_bytes=1 << 16)
    rows.orderBy(F.rand(3)).write.partitionBy("dt").option("parquet.block.size", str(1 << 16)).parquet(str(tmp_path / "plain"))
    for where in ("session_id = 70007", "server_id = 13"):
        found = [spark.read.parquet(str(tmp_path / name)).where(where) for name in ("z", "plain")]
        assert found[0].count() == found[1].count() > 0
        with_scan = [f.select("session_id", "server_id") for f in found]
        a, b = map(scanned, with_scan)
        assert a < b / 3, (where, a, b)


def entry(k: int, lines: int) -> list[str]:
    ts = datetime(2024, 1, 30) + timedelta(seconds=k)
    return [f"{ts:%Y-%m-%d %H:%M:%S}.00 spid{k % 9}s   entry {k} begins", *(f"   line {j} of entry {k}, with some more text to fill it" for j in range(1, lines))]


@pytest.mark.parametrize("split", ["200", "1k", "128m"])
def test_entries_across_file_splits(spark, tmp_path, split):
    """One file over many tasks, cut inside entries of many lines: every entry is whole."""
    rng = random.Random(1)
    want = []
    for server in (1, 2):
        folder = tmp_path / f"server_id={server}" / "log_id=0"
        folder.mkdir(parents=True)
        entries = [entry(k, rng.choice([1, 1, 2, 40])) for k in range(60)]
        (folder / "a.txt").write_text("\n".join(["before any entry", *[x for e in entries for x in e]]) + "\n")
        want += [(server, datetime(2024, 1, 30) + timedelta(seconds=k), "\n".join([f"entry {k} begins", *e[1:]])) for k, e in enumerate(entries)]
        want.append((server, None, "before any entry"))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        splits = located_lines(spark, str(tmp_path)).select("file", "split").distinct().count()
        got = read_error_log(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert (splits > 20) == (split != "128m")
    assert Counter((r["server_id"], r["event_ts"], r["text"]) for r in got) == Counter(want)
    assert {r["log_type"] for r in got} == {None, *(f"spid{k}s" for k in range(9))}


def test_restart_phrase_in_a_later_line_of_an_entry(spark, tmp_path):
    folder = tmp_path / "server_id=7" / "log_id=1"
    folder.mkdir(parents=True)
    (folder / "a.txt").write_text("2024-01-30 01:02:03.45 Server   some message\n  the server is starting now\n")
    r = history.restart_events(Telemetry.from_frames(spark, error_log=read_error_log(spark, str(tmp_path)))).first()
    assert (r["server_id"], r["event_ts"].second, r["line_number"], r["phrase"]) == (7, 3, 1, "is starting")
