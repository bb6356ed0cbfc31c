from __future__ import annotations

import random
from collections import Counter
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from fleetgauge.operators.asof import as_of_join
from fleetgauge.operators.waits_for import analyse, per_snapshot
from fleetgauge.operators.previous import with_previous
from fleetgauge.operators.heavy import heavy_values, summaries
from fleetgauge.operators.running import frequencies, ranges, with_rows_below
from fleetgauge.operators.topk import top_overall, top_per
from fleetgauge.plans import baseline, blocking, column_stats, sketches, waiting
from fleetgauge.sources.base_tables import read_base
from report_helpers import SMALL, graded


def test_top_k_does_not_depend_on_partitioning(spark):
    rows = [(i % 3, i % 5, i) for i in range(300)]
    results = []
    for seed, parts in ((1, 1), (2, 7)):
        random.Random(seed).shuffle(rows)
        df = spark.createDataFrame(rows, "k int, v int, id int").repartition(parts)
        per = top_per(df, ["k"], [F.desc("v"), "id"], 4).collect()
        results.append((sorted(map(tuple, per)), [tuple(r) for r in top_overall(df, [F.desc("v"), "id"], 5).collect()]))
    assert results[0] == results[1]


def test_previous_equals_plain_lag_for_a_hot_key(spark):
    """One key holds most rows; slices, ties of the time and gaps between slices."""
    rng = random.Random(7)
    start = datetime(2024, 1, 1)
    rows = [(0 if rng.random() < 0.7 else rng.randint(1, 3), start + timedelta(minutes=rng.randint(0, 5000)), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "k int, ts timestamp, id int")
    got = {r["id"]: r["prev_id"] for r in with_previous(df, ["k"], ["ts", "id"], F.date_trunc("hour", "ts"), ["id"]).collect()}
    want, last = {}, {}
    for k, ts, i in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        want[i], last[k] = last.get(k), i
    assert got == want


@pytest.mark.parametrize("slices", [2, 16, 256])
def test_rows_below_equals_a_sort(spark, slices):
    rng = random.Random(slices)
    rows = [(rng.choice("ab"), None if rng.random() < 0.05 else int(rng.paretovariate(0.4)) % 5000) for _ in range(4000)]
    df = spark.createDataFrame(rows, "k string, v long")
    for keys in ([], ["k"]):
        got = {(tuple(r[k] for k in keys), r["value"]): (r["below"], r["total"])
               for r in with_rows_below(frequencies(df, keys, "v"), keys, slices).collect()}
        groups = {}
        for k, v in rows:
            if v is not None:
                groups.setdefault((k,) if keys else (), []).append(v)
        want = {(g, v): (sum(x < v for x in vs), len(vs)) for g, vs in groups.items() for v in set(vs)}
        assert got == want


def test_rows_below_in_any_projection(spark):
    df = spark.range(1000).selectExpr("id % 37 AS v")
    placed = with_rows_below(frequencies(df, [], "v"))
    assert placed.select("below", "value").count() == placed.select("value").count() == 37
    assert placed.agg(F.sum("rows")).first()[0] == 1000


@pytest.mark.parametrize("skewed", [False, True])
def test_ranges_follow_the_data(spark, skewed):
    """A million distinct values, evenly spread or most of them close together: no slice is much over the middle one."""
    value = "CAST(pow(id / 1000.0, 3) AS BIGINT) + id % 7" if skewed else "id * 7919 % 1000003"
    freq = spark.range(1_000_000).selectExpr(f"{value} AS value").groupBy("value").agg(F.count("*").alias("rows"))
    sizes = sorted(r["count"] for r in ranges(freq, ["value"], 40).groupBy("_slice").count().collect())
    assert len(sizes) >= 38 and sizes[-1] <= 2 * sizes[len(sizes) // 2]


def test_ranges_of_many_small_keys_share_slices(spark):
    freq = spark.range(20_000).selectExpr("id % 5000 AS k", "id AS value", "id % 3 + 1 AS rows")
    got = with_rows_below(freq, ["k"], 16)
    want = freq.selectExpr("k", "value", "coalesce(sum(rows) OVER (PARTITION BY k ORDER BY value ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below", "sum(rows) OVER (PARTITION BY k) AS total")
    got = got.select("k", "value", "below", "total")
    assert got.count() == 20_000 and got.exceptAll(want).isEmpty()


def test_headers_equal_the_header_of_each_column(spark):
    rows = spark.range(3000).selectExpr(
        "CASE WHEN id % 11 > 0 THEN id % 170 END AS whole", "CAST(id % 7 AS DOUBLE) / 3 AS number", "concat('t', id % 900) AS words",
        "CASE WHEN id % 2 = 0 THEN date_add(DATE '2024-01-01', CAST(id % 400 AS INT)) END AS day", "CAST(id % 13 AS DECIMAL(9,2)) AS money",
        "CAST(NULL AS BIGINT) AS nothing", "1 AS one",
    )
    updated = datetime(2024, 1, 31)
    got = {r["column_name"]: r.asDict() for r in column_stats.headers(rows, rows.columns, updated, 50).collect()}
    assert set(got) == set(rows.columns)
    for c in rows.columns:
        assert got[c] == column_stats.header(rows, c, updated, 50).first().asDict(), c


def test_headers_read_the_table_once(spark):
    plan = column_stats.headers(read_base(spark, SMALL, "lineitem"), ["l_partkey", "l_suppkey"], datetime(2024, 1, 31))._jdf.queryExecution().executedPlan().toString()
    assert "lineitem" not in plan  # what follows reads the stored running counts only


@pytest.mark.parametrize("order", ["as it is", "heavy first", "heavy last", "in turn"])
def test_heavy_values_in_any_order(spark, order):
    """Values just over and just under the share, among many that a summary has to drop, in orders that wear counters down."""
    rng, n, share = random.Random(5), 20_000, 0.02
    heavy = [f"h{k}" for k in range(6) for _ in range(401 + 40 * k)]
    under = [f"u{k}" for k in range(9) for _ in range(399)]
    light = [f"x{k}" for k in range(n - len(heavy) - len(under))]
    rows = heavy + under + light
    if order == "heavy last":
        rows = rows[::-1]
    elif order == "in turn":
        rows = [v for pair in zip(light, (heavy + under) * 3) for v in pair][: n // 2] + rows
    elif order == "as it is":
        rng.shuffle(rows)
    df = spark.createDataFrame([("c", v) for v in [*rows, None, None]], "column_name string, value string").repartition(3) if order == "as it is" else (
        spark.createDataFrame([("c", v) for v in rows], "column_name string, value string").coalesce(1)
    )
    counts = Counter(v for v in rows)
    want = {v: c for v, c in counts.items() if c > share * len(rows)}
    assert {r["value"]: r["rows"] for r in heavy_values(df, share).collect()} == want and len(want) >= 6


def test_summaries_are_bounded(spark):
    df = spark.range(50_000).selectExpr("'c' AS column_name", "CAST(id AS STRING) AS value").repartition(2)
    assert summaries(df, 10).groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0] in (None, *range(11))
    assert heavy_values(df, 0.5).isEmpty() and heavy_values(df.limit(0), 0.5).isEmpty()


def test_deadlocks_over_time(make):
    """Cycles that last, part, come back, and change their members; more samples of the same states give no more events."""
    rng = random.Random(8)
    start = datetime(2024, 1, 1)
    states = []  # per hour: the cycles (as tuples of sessions)
    for _ in range(40):
        cycles = [c for c in ((1, 2), (3, 4, 5), (6, 7)) if rng.random() < 0.6]
        states.append([(3, 4) if c == (3, 4, 5) and rng.random() < 0.3 else c for c in cycles])

    def events(rate):
        rows = []
        for h, cycles in enumerate(states):
            for k in range(rate):
                ts = start + timedelta(hours=h, minutes=60 * k // rate)
                rows.append({"server_id": 1, "snapshot_ts": ts, "session_id": 99, "blocking_session_id": 0})
                rows += [{"server_id": 1, "snapshot_ts": ts, "session_id": a, "blocking_session_id": b} for c in cycles for a, b in zip(c, (*c[1:], c[0]))]
        found = blocking.mutual_wait_events(make(request_snapshot=rows), start, start + timedelta(days=9)).collect()
        return sorted((r["members"], r["started"], r["ended"].replace(minute=0), r["snapshots"] // rate) for r in found)

    want = []
    for c in {c for s in states for c in s}:
        held = [c in s for s in states]
        begins = [h for h in range(40) if held[h] and (h == 0 or not held[h - 1])]
        for b in begins:
            e = next((h for h in range(b, 40) if not held[h]), 40) - 1
            want.append((",".join(map(str, c)), start + timedelta(hours=b), start + timedelta(hours=e), e - b + 1))
    assert events(1) == sorted(want) and events(4) == sorted(want)


def sketch_source(spark):
    return spark.range(60_000).selectExpr(
        "CAST(pow(id % 9973, 1.5) AS BIGINT) AS number", "concat('k', id % 17000) AS word", "CASE WHEN id % 10 > 0 THEN CAST(id AS DOUBLE) / 7 END AS gap",
        "date_add(DATE '2024-01-01', CAST(id % 6 AS INT)) AS dt",
    )


@pytest.mark.parametrize("cut", ["dt", "number % 3", "1"])
def test_merged_sketches_keep_their_bounds(spark, cut):
    """However the rows are cut into partitions, merged sketches stay within the stated errors of exact counts and ranks."""
    rows, columns = sketch_source(spark).withColumn("part", F.expr(cut)), ["number", "word", "gap"]
    quantiles = (0.1, 0.5, 0.9)
    found = {r["column_name"]: r for r in sketches.statistics(sketches.merged(sketches.partition_sketches(rows, columns, "part")), quantiles).collect()}
    for c in columns:
        values = sorted(r[0] for r in rows.select(c).where(F.col(c).isNotNull()).collect())
        exact = len(set(values))
        assert abs(found[c]["distinct_values"] - exact) <= sketches.DISTINCT_ERROR * exact
        assert (found[c]["rows"], found[c]["null_rows"]) == (60_000, 60_000 - len(values))
        if c != "word":
            assert (found[c]["low"], found[c]["high"]) == (values[0], values[-1])
            for q in quantiles:
                at = found[c][f"q{round(100 * q)}"]
                below, up_to = sum(v < at for v in values) / len(values), sum(v <= at for v in values) / len(values)
                assert below - sketches.RANK_ERROR <= q <= up_to + sketches.RANK_ERROR
        else:
            assert found[c]["q50"] is None and found[c]["low"] is None


def test_refresh_reads_changed_partitions_only(spark, tmp_path, monkeypatch):
    table, store, columns = str(tmp_path / "t"), str(tmp_path / "s"), ["number", "word"]
    rows = sketch_source(spark)
    rows.where("dt < DATE '2024-01-06'").write.partitionBy("dt").parquet(table)
    plans, made = [], sketches.partition_sketches

    def seen(df, *rest):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return made(df, *rest)

    monkeypatch.setattr(sketches, "partition_sketches", seen)
    days = [datetime(2024, 1, d).date() for d in range(1, 7)]
    assert sketches.refresh(spark, table, store, columns) == days[:5]
    assert sketches.refresh(spark, table, store, columns) == [] and len(plans) == 1
    rows.where("dt = DATE '2024-01-06'").write.mode("append").partitionBy("dt").parquet(table)
    rows.where("dt = DATE '2024-01-02'").limit(10).write.mode("append").partitionBy("dt").parquet(table)
    assert sketches.refresh(spark, table, store, columns) == [days[1], days[5]]
    assert "PartitionFilters: [dt" in plans[1] and "gap" not in plans[1].split("ReadSchema")[0].split("PushedFilters")[0] or "2024-01-02" in plans[1]
    got = sketches.merged(sketches.stored(spark, table, store)).select("column_name", "rows").collect()
    assert {r["column_name"]: r["rows"] for r in got} == {"number": 60_010, "word": 60_010}


def test_histogram_properties(spark):
    lines = read_base(spark, SMALL, "lineitem")
    for column in ("l_partkey", "l_shipdate", "l_returnflag", "l_quantity"):
        steps = column_stats.histogram(lines, column).collect()
        assert len(steps) <= column_stats.MAX_STEPS
        assert sum(r["range_rows"] + r["eq_rows"] for r in steps) == lines.count()
        assert sum(r["distinct_range_rows"] + 1 for r in steps) == lines.select(column).distinct().count()


def test_histogram_with_a_dominant_value_and_nulls(spark):
    df = spark.range(1000).selectExpr("CASE WHEN id < 950 THEN 7 WHEN id < 990 THEN id END AS v")
    steps = {r["range_hi_key"]: r for r in column_stats.histogram(df, "v", 10).collect()}
    assert sum(r["range_rows"] + r["eq_rows"] for r in steps.values()) == 990
    assert steps[7]["eq_rows"] == 950
    head = column_stats.header(df, "v", datetime(2024, 1, 31), 10).first()
    assert (head["rows"], head["null_rows"], head["distinct_values"]) == (1000, 10, 41)
    approximate = column_stats.header(df, "v", datetime(2024, 1, 31), 10, approximate=True).first()
    assert abs(approximate["distinct_values"] - 41) <= 4 and approximate["null_rows"] == 10


def test_skew_examples(spark):
    df = spark.range(100_000).selectExpr("IF(id < 95000, 1, id) AS month", "id % 2 AS half")
    got = {r["column_name"]: (float(r["top_share_pct"]), r["reason"]) for r in column_stats.skew(df, ["month", "half"]).collect()}
    assert got == {"month": (95.0, "dominant_value"), "half": (50.0, "skewed")}


def test_misestimates(spark):
    rows = spark.createDataFrame([(50_000, 1.0), (10, 90_000.0), (950_000, 300.0), (10, 100.0)], "actual_rows long, estimated_rows double")
    got = [(round(r["q_error"]), r["reason"]) for r in column_stats.graded_estimates(rows).collect()]
    assert got == [(50_000, "misestimated"), (9_000, "misestimated"), (3_167, "misestimated"), (10, "ok")]


def test_estimates_from_a_histogram(spark):
    old = spark.range(1000).selectExpr("IF(id < 500, 1, id) AS v")
    steps = column_stats.histogram(old, "v", 4)
    actual = spark.createDataFrame([(1, 500), (600, 1), (5000, 7)], "value long, rows long")
    got = {r["value"]: (r["estimated_rows"], r["q_error"]) for r in column_stats.estimates(steps, actual).collect()}
    assert got[1] == (500.0, 1.0) and got[600] == (1.0, 1.0)
    assert got[5000] == (1.0, 7.0)  # beyond the last step
    keys = {r["range_hi_key"]: r["eq_rows"] for r in steps.collect()}
    known = [k for k in keys if k not in (1, 600, 5000)]
    assert known and all(got[k] == (float(keys[k]), float(keys[k])) for k in known)  # in the histogram, but no rows any more


def test_sampled_histogram_is_close(spark):
    df = spark.range(100_000).selectExpr("id", "id % 50 AS v")
    full = column_stats.sampled_histogram(df, "v", 100, column_stats.row_bucket("id"))
    assert full.agg(F.sum("eq_rows") + F.sum("range_rows")).first()[0] == 100_000
    part = column_stats.sampled_histogram(df, "v", 30, column_stats.row_bucket("id"))
    assert abs(part.agg(F.sum("eq_rows") + F.sum("range_rows")).first()[0] - 100_000) < 3_000
    head = column_stats.header(df, "v", datetime(2024, 1, 31), sample=column_stats.row_bucket("id"), percent_rows=30).first()
    assert head["rows"] == 100_000 and 28_000 < head["rows_sampled"] < 32_000 and head["distinct_values"] == 50


def test_parameter_spread(make):
    ts = datetime(2024, 1, 1)
    t = make(
        qs_runtime=[{"server_id": 1, "runtime_id": i, "plan_id": 1, "avg_duration": d, "count_executions": 4, "last_execution_time": ts} for i, d in enumerate((5, 80_000))],
        qs_plan=[{"server_id": 1, "plan_id": 1, "query_id": 9}],
    )
    row = column_stats.parameter_spread(t).first()
    assert row["executions"] == 8
    assert (row["median_us"], float(row["max_over_median"]), float(row["max_over_min"]), row["reason"]) == (5, 16000.0, 16000.0, "very_unstable")


def test_waits_for_graphs():
    """Chains, a star, two leaders of one session, a cycle with a tail, a session that waits for itself."""
    chain = [(100 + n, 100 + n - 1) for n in range(1, 41)] + [(200 + n, 140) for n in range(30)]
    leaders, cycles = analyse(chain)
    assert leaders == [(100, 70, 41)] and cycles == []
    assert analyse([(10, 11), (10, 5)])[0] == [(5, 1, 1), (11, 1, 1)]
    ring = [(300 + n, 300 + (n + 1) % 5) for n in range(5)]
    leaders, cycles = analyse([*ring, (310, 302), (311, 310), (320, 320), (301, 301)])
    assert leaders == [(300, 2, 2)] and cycles == [(300, 300 + n, 5) for n in range(5)]
    # a cycle that waits for a session outside is behind it, as a whole
    leaders, cycles = analyse([*ring, (304, 7)])
    assert leaders == [(7, 5, 5)] and len(cycles) == 5
    assert analyse([]) == ([], [])


def test_waits_per_snapshot(spark):
    edges = [(s, n, p) for s in (1, 2) for n, p in ((30, 32), (32, 30), (31, 30), (33, 31), (9, 8))]
    df = spark.createDataFrame(edges, "server_id int, n long, p long").repartition(5)
    got = sorted(tuple(r) for r in per_snapshot(df, ["server_id"], "n", "p", True).collect())
    assert got == [(s, leader, behind, hops) for s in (1, 2) for leader, behind, hops in ((8, 1, 1), (30, 2, 2))]
    got = sorted(tuple(r) for r in per_snapshot(df, ["server_id"], "n", "p", False).collect())
    assert got == [(s, 30, n, 2) for s in (1, 2) for n in (30, 32)]
    assert per_snapshot(df.limit(0), ["server_id"], "n", "p", True).isEmpty()


@pytest.mark.parametrize(("how", "slice_unit"), [("inner", "month"), ("left", "day"), ("inner", "hour")])
def test_as_of_join_against_brute_force(spark, how, slice_unit):
    """Random times with ties, keys without the other side, and missing times; one hot key holds half of the rows."""
    rng = random.Random(len(how) + len(slice_unit))
    moment = lambda: None if rng.random() < 0.05 else datetime(2024, 1, 1) + timedelta(minutes=30 * rng.randrange(4000))
    key = lambda: 0 if rng.random() < 0.5 else rng.randrange(1, 9)
    left = [(key(), k, moment()) for k in range(400)]
    right = [(key(), 1000 + k, moment()) for k in range(150)]
    now, long_ago = datetime(9999, 1, 1), datetime(1, 1, 1)

    def met(k, t):
        found = [(r[2] or long_ago, r[1]) for r in right if r[0] == k and (r[2] or long_ago) <= (t or now)]
        return max(found)[1] if found else None

    want = sorted((k, n, met(k, t)) for k, n, t in left if how == "left" or met(k, t) is not None)
    a = spark.createDataFrame(left, "k int, n int, t timestamp").repartition(5)
    b = spark.createDataFrame(right, "k int, v int, t timestamp").repartition(3)
    joined = as_of_join(a, b, ["k"], F.col("t"), F.col("t"), ["v"], how=how, slice_unit=slice_unit)
    assert sorted(tuple(r) for r in joined.select("k", "n", "was_v").collect()) == want if how == "inner" else (
        sorted(tuple(r) for r in joined.select("k", "n", F.coalesce("was_v", F.lit(-1))).collect()) == sorted((k, n, -1 if v is None else v) for k, n, v in want)
    )
    assert joined.columns == ["k", "n", "t", "was_v"]


def test_as_of_join_spreads_a_hot_key(spark):
    """No join of pairs, and the sort of one key is cut by time slice."""
    rows = spark.range(1000).select(F.lit(1).alias("k"), "id", F.timestamp_seconds(F.col("id") * 86400).alias("t"))
    plan = as_of_join(rows, rows, ["k"], F.col("t"), F.col("t"), ["id"])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window [last(_met") == 1 and "[k" in plan and "_slice" in plan.split("Window [last(_met")[1].split("\n")[0]
    assert plan.count("Join") == 1


def test_wait_delta_options(spark):
    before = spark.createDataFrame([(1, "A", 10, 1), (1, "B", 50, 1)], "server_id int, wait_type string, wait_time_ms long, waiting_tasks_count long")
    after = spark.createDataFrame([(1, "A", 60_011, 3), (1, "B", 50, 1), (1, "C", 10_000, 1)], before.schema)
    assert graded(waiting.wait_delta(before, after), "wait_type") == {"A": "over_1min"}
    assert graded(waiting.wait_delta(before, after, include_new=True), "wait_type") == {"A": "over_1min", "C": "ok"}


def test_deltas_of_captures_add_up(telemetry):
    """Without resets, the deltas of a series sum to the last reading minus the first."""
    rows = waiting.sampled_deltas(telemetry)
    series = telemetry["wait_series"].where(F.col("snapshot_ts") < "2024-01-15")
    total = rows.where(F.col("snapshot_ts") < "2024-01-15").agg(F.sum("delta_ms")).first()[0]
    ends = series.groupBy("server_id", "wait_type").agg(
        (F.max_by("wait_time_ms", "snapshot_ts") - F.min_by("wait_time_ms", "snapshot_ts")).alias("d")
    )
    assert total == ends.agg(F.sum("d")).first()[0]


@pytest.mark.parametrize("before,after,reason", [
    ((0, 0, 0, 0), (1001, 0, 999, 0), "works_well"), ((0, 0, 0, 0), (1001, 0, 1000, 0), "used"), ((0, 0, 0, 0), (100, 0, 10001, 0), "many_lookups"),
    ((0, 0, 0, 0), (5, 1001, 0, 0), "scans_dominate"), ((0, 0, 0, 0), (0, 0, 0, 1), "write_cost_only"), ((9, 9, 9, 9), (9, 9, 9, 9), "no_activity"),
    ((0, 0, 0, 0), (1, 0, 0, 5), "little_used"),
])
def test_index_usage_delta(spark, before, after, reason):
    schema = "phase string, server_id int, database_id int, table_name string, index_name string, seeks long, scans long, lookups long, updates long"
    table = spark.createDataFrame([("before", 1, 5, "t", "i", *before), ("7d", 1, 5, "t", "i", *after), ("24h", 1, 5, "t", "i", 0, 0, 0, 0)], schema)
    assert baseline.index_usage_delta(table).first()["reason"] == reason


@pytest.mark.parametrize("wait,before,after,reason", [
    ("PAGEIOLATCH_SH", 5, 4, "io_improved"), ("CXPACKET", 5, 4, "parallelism_reduced"), ("PAGEIOLATCH_EX", 4, 5, "io_worse"),
    ("WRITELOG", 4, 5, "log_grew"), ("LCK_M_S", 4, 5, "lock_contention_grew"), ("CXPACKET", 4, 5, "no_significant_change"), ("WRITELOG", 0, 5, "log_grew"),
])
def test_wait_change(spark, wait, before, after, reason):
    table = spark.createDataFrame([("before", 1, wait, before), ("7d", 1, wait, after)], "phase string, server_id int, wait_type string, wait_time_ms long")
    row = baseline.wait_change(table).first()
    assert row["reason"] == reason and (row["change_pct"] is None) == (before == 0)
