"""What the physical plans must look like at any size."""

from __future__ import annotations

import re
from datetime import datetime

import pytest
from report_helpers import SMALL
from pyspark.sql import functions as F

from __spark_entry__ import queries
from fleetgauge.plans import lookups, registry, sessions, waiting
from fleetgauge.sources.telemetry import Telemetry
from fleetgauge.streaming.registry import _texts_by_handle


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture()
def no_broadcast(spark):
    """Plans as for tables that are too large to broadcast."""
    names = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    for name in names:
        spark.conf.set(name, "-1")
    yield
    for name in names:
        spark.conf.unset(name)


@pytest.mark.parametrize("name", ["q02_activity_log_latest", "q09b_maintenance_log", "q03_active_requests", "q04a_query_cpu", "q05_wait_ranking", "q08_missing_indexes", "q13b_qs_top_duration", "q15b_temp_by_session", "q19a_cached_plans", "x05_cache_topk"])
def test_top_k_per_group_is_limited_before_the_shuffle(spark, name):
    assert re.search(r"WindowGroupLimit .*Partial", plan(queries()[name](spark, SMALL)))


@pytest.mark.parametrize("name", [n for n in sorted(queries()) if n.startswith("q")])
def test_no_table_goes_through_one_task(spark, no_broadcast, name):
    text = plan(queries()[name](spark, SMALL))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    assert "SinglePartition" not in text
    assert "BatchEvalPython" not in text and "ArrowEvalPython" not in text


def test_filters_and_columns_reach_the_scan(spark, telemetry, tmp_path):
    telemetry["backupset"].write.parquet(str(tmp_path / "backupset"))
    from fleetgauge.plans.history import monthly_size

    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    text = plan(monthly_size(Telemetry.from_files(spark, str(tmp_path)), datetime(2001, 8, 2)))
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    scan = next(line for line in text.splitlines() if "FileScan" in line)
    assert "EqualTo(type,D)" in scan and "GreaterThanOrEqual(backup_finish_date" in scan
    assert "compressed_backup_size" not in scan


def test_text_is_not_carried_through_ranking(spark, no_broadcast):
    """The ranked rows are cut before they meet the statement texts."""
    text = plan(queries()["q03_active_requests"](spark, SMALL))
    window = next(line for line in text.splitlines() if "WindowGroupLimit" in line)
    depth = window.index("WindowGroupLimit")
    below = text[text.index(window):].splitlines()[1:]
    scans = [line for line in below if "FileScan" in line and line.index("FileScan") > depth]
    texts = [line for line in scans if "doc_id" in line]
    assert texts and not any(re.search(r"FileScan parquet \[[^\]]*text#", line) for line in texts[:1])


@pytest.mark.parametrize("name", ["q13b_qs_top_duration", "q13c_plan_regression_pairs", "q28h_qs_reads_impact", "q29c_qs_recent", "q34a_regressions", "q34a_regressions_1h"])
def test_query_texts_are_not_ranked(spark, no_broadcast, name):
    """Texts are looked up for the ranked rows only."""
    windows, nodes = [], [queries()[name](spark, SMALL)._jdf.queryExecution().optimizedPlan()]
    while nodes:
        node = nodes.pop()
        children = node.children()
        nodes += [children.apply(k) for k in range(children.size())]
        if node.nodeName() == "Window":
            windows.append(node.output().mkString(","))
    assert windows and not any("query_sql_text" in columns for columns in windows)


def test_a_hot_key_is_split(spark, no_broadcast):
    """Half of all rows share one statement: the lookup still runs in many tasks."""
    settings = {
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20KB",
        "spark.sql.shuffle.partitions": "16",
    }
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        rows = spark.range(0, 200_000, 1, 16).selectExpr("id", "IF(id % 2 = 0, 7, id % 1000) AS sql_handle", "uuid() AS pad")
        texts = spark.range(1000).selectExpr("id AS sql_handle", "concat('q', id) AS text")
        t = Telemetry.from_frames(spark, sql_text=texts)
        joined = lookups.with_text(rows, t).select("id", "text", "pad")
        pairs = joined.where("length(pad) > 0").select("id", "text")
        counted = {r[0]: r[1] for r in pairs.groupBy("text").count().collect()}
        joined.write.format("noop").mode("overwrite").save()
        rows_out = joined.collect()
        assert len(rows_out) == 200_000 and counted["q7"] == 100_200
        assert "skew=true" in plan(joined)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_shares_of_a_hot_server(spark, make):
    """A server with most rows: ranked rows only meet the totals after the group limit."""
    waits = spark.range(50_000).selectExpr(
        "IF(id % 3 > 0, 1L, id) AS server_id", "concat('W', id) AS wait_type", "1L AS waiting_tasks_count",
        "id AS wait_time_ms", "0L AS signal_wait_time_ms", "0L AS max_wait_time_ms",
    )
    t = Telemetry.from_frames(spark, wait_snapshot=waits)
    hot = waiting.wait_ranking(t).where("server_id = 1").orderBy("rank").collect()
    assert [r["wait_time_ms"] for r in hot[:3]] == [49_999, 49_997, 49_996] and len(hot) == 20
    total = waits.where("server_id = 1").agg(F.sum("wait_time_ms")).first()[0]
    assert float(hot[0]["share_pct"]) == round(100 * 49_999 / total, 2)


def test_bucketed_tables_join_without_a_shuffle(spark, telemetry, no_broadcast, tmp_path):
    from fleetgauge.plans.sessions import user_requests
    from fleetgauge.sources.sinks import save_bucketed

    keys = ["server_id", "snapshot_ts", "session_id"]
    try:
        for name in ("request_snapshot", "session_snapshot"):
            save_bucketed(telemetry[name], f"bucketed_{name}", keys, 4, str(tmp_path / name))
        joined = user_requests(Telemetry.from_catalog(spark, "bucketed_"))
        assert "Exchange" not in plan(joined)
        assert joined.count() == user_requests(telemetry).count()
    finally:
        for name in ("request_snapshot", "session_snapshot"):
            spark.sql(f"DROP TABLE IF EXISTS bucketed_{name}")


def test_reading_order(telemetry):
    from fleetgauge.plans.ordering import ORDERS, ordered
    from fleetgauge.plans.registry import REPORTS

    assert set(ORDERS) <= set(REPORTS)
    for name in ORDERS:
        report = REPORTS[name](telemetry)
        assert {c.lstrip("-") for c in ORDERS[name]} <= set(report.columns), name
    rows = ordered("q25_autogrowth", REPORTS["q25_autogrowth"](telemetry)).collect()
    keys = [(r["server_id"], r["sort_bucket"], r["database_id"]) for r in rows]
    assert keys == sorted(keys) and len({k[1] for k in keys}) == 3
    ages = ordered("q21_integrity_age", REPORTS["q21_integrity_age"](telemetry)).where("server_id = 0").collect()
    days = [r["days_since_check"] for r in ages]
    known = [d for d in days if d is not None]
    assert known == sorted(known, reverse=True) and days[len(known):] == [None] * (len(days) - len(known))


@pytest.mark.parametrize("report", [sessions.collected_sessions, sessions.collected_blocks])
def test_collected_texts_meet_the_rows_last(telemetry, no_broadcast, report):
    """No join but those that look texts up has a text below it, so that none shuffles one."""
    joins = [x for x in plan(report(telemetry, datetime(2024, 1, 31))).splitlines() if "SortMergeJoin" in x]
    by_text = ["handle" in x for x in joins]
    assert any(by_text) and by_text == sorted(by_text, reverse=True)


def test_bucketed_texts_are_not_shuffled_by_batches(spark, telemetry, no_broadcast):
    table = _texts_by_handle(telemetry)
    try:
        t = telemetry.replaced(sql_text=spark.table(table))
        for report in (sessions.collected_sessions, sessions.collected_blocks):
            text = plan(report(t, datetime(2024, 1, 31)))
            scans = re.findall(r"Bucketed: (true|false)[^\n]*text:string", text)
            assert scans and set(scans) == {"true"}
        assert spark.table(table).count() == telemetry["sql_text"].count()
    finally:
        spark.sql(f"DROP TABLE {table}")


def test_sums_by_part_need_no_shuffle_of_lines(spark, telemetry):
    with registry._lines_by_part(spark, SMALL) as lines:
        for name in registry.BY_PART:
            own = Telemetry.derived(spark, SMALL, lineitem=lines)[name]
            # an index that shares another's lines is named anew, and its sums move once
            assert plan(own).count("Exchange hashpartitioning") == name.startswith("index_usage"), name
            assert own.exceptAll(telemetry[name]).isEmpty() and telemetry[name].exceptAll(own).isEmpty()
