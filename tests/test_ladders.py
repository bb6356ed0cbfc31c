"""Ladders at their thresholds: one below, at, and above; and the order of their rungs."""

from __future__ import annotations

from datetime import datetime, timedelta

import pytest
from report_helpers import graded

from fleetgauge.plans import history, indexes, query_store, servers, sessions, statistics, storage, waiting, workload

NOW = datetime(2024, 1, 31)
TS = datetime(2024, 1, 30)


@pytest.mark.parametrize("days,reason", [(0, "waits_not_accumulated"), (1, "waits_reliable"), (6, "waits_reliable"), (7, "use_deltas")])
def test_uptime_confidence(make, days, reason):
    t = make(server_info=[{"server_id": 1, "start_time": NOW - timedelta(days=days)}])
    assert graded(servers.uptime_confidence(t, NOW), "server_id") == {1: reason}


@pytest.mark.parametrize(
    "up,reason",
    [
        (timedelta(minutes=59), "restarted_within_24h"),  # crosses an hour boundary
        (timedelta(0), "restarted_within_1h"),
        (timedelta(hours=23), "restarted_within_24h"),
        (timedelta(hours=24), "restarted_within_7d"),
        (timedelta(days=7), "ok"),
    ],
)
def test_availability(make, up, reason):
    t = make(server_info=[{"server_id": 1, "start_time": NOW - up}])
    row = servers.availability(t, NOW).first()
    assert row["reason"] == reason
    assert row["counter_reason"] == ("counters_incomplete" if up < timedelta(hours=24) else "counters_sufficient")


def session(i, **more):
    return {"server_id": 1, "snapshot_ts": TS, "session_id": i, "is_user_process": 1, "login_name": "a",
            "host_name": "h", "program_name": "p", "status": "sleeping", "last_request_end_time": NOW, **more}


@pytest.mark.parametrize("n,reason", [(50, "ok"), (51, "over_50_connections"), (100, "over_50_connections"), (101, "over_100_connections")])
def test_session_groups_by_count(make, n, reason):
    t = make(session_snapshot=[session(i) for i in range(n)])
    row = sessions.session_groups(t, NOW).first()
    assert (row["connections"], row["sleeping"], row["reason"]) == (n, n, reason)


@pytest.mark.parametrize("minutes,reason", [(60, "ok"), (61, "idle_over_1h")])
def test_session_groups_by_idle_time(make, minutes, reason):
    t = make(session_snapshot=[session(1, last_request_end_time=NOW - timedelta(minutes=minutes))])
    assert sessions.session_groups(t, NOW).first()["reason"] == reason


def test_idle_sessions_keep_only_those_over_half_an_hour(make):
    ages = {1: 30, 2: 31, 3: 120, 4: 121}
    t = make(session_snapshot=[session(i, last_request_end_time=NOW - timedelta(minutes=m)) for i, m in ages.items()])
    assert graded(sessions.idle_sessions(t, NOW), "session_id") == {2: "idle_over_30min", 3: "idle_over_30min", 4: "idle_over_2h"}


@pytest.mark.parametrize("n,reason", [(100, "ok"), (101, "over_100"), (200, "over_100"), (201, "over_200")])
def test_connections_per_database(make, n, reason):
    t = make(
        session_snapshot=[session(i) for i in range(n)],
        request_snapshot=[{"server_id": 1, "snapshot_ts": TS, "session_id": i, "database_id": 5} for i in range(n)],
        database_dim=[],
    )
    assert sessions.connections_per_database(t).first()["reason"] == reason


def request(i, **more):
    return {"server_id": 1, "snapshot_ts": TS, "session_id": i, "request_id": 0, "blocking_session_id": 0, "cpu_time": 0,
            "total_elapsed_time": 0, "wait_time": 0, "sql_handle": 1, "database_id": 5,
            "statement_start_offset": 0, "statement_end_offset": -1, **more}


def test_active_requests_order_of_rungs(make):
    rows = [
        request(51, blocking_session_id=60, cpu_time=99999999), request(52, cpu_time=60001),
        request(53, cpu_time=60000, total_elapsed_time=301000), request(54, total_elapsed_time=300999),
        request(50, cpu_time=1), request(55, sql_handle=9),
    ]
    t = make(
        request_snapshot=rows, session_snapshot=[session(r["session_id"]) for r in rows],
        sql_text=[{"sql_handle": 1, "text": "select 1"}], database_dim=[],
    )
    # session 50 is a system session, the text of session 55 is unknown
    assert graded(sessions.active_requests(t), "session_id") == {51: "blocked", 52: "high_cpu", 53: "long_running", 54: "ok"}


@pytest.mark.parametrize("ms,reason", [(10999, "recent"), (11000, "blocked_over_10s"), (60999, "blocked_over_10s"), (61000, "blocked_over_60s")])
def test_blocking_pairs(make, ms, reason):
    t = make(request_snapshot=[request(60), request(61, blocking_session_id=60, wait_time=ms)],
             sql_text=[{"sql_handle": 1, "text": "x"}], database_dim=[])
    assert graded(sessions.blocking_pairs(t), "blocked_session_id") == {61: reason}


@pytest.mark.parametrize("waiting_rows,reason", [(0, "ok"), (1, "queries_waiting"), (5, "queries_waiting"), (6, "long_grant_queue")])
def test_grant_summary(make, waiting_rows, reason):
    grants = [{"server_id": 1, "snapshot_ts": TS, "session_id": i, "grant_time": None if i < waiting_rows else TS,
               "granted_memory_kb": 1024, "used_memory_kb": 512} for i in range(8)]
    row = servers.grant_summary(make(memory_grant=grants)).first()
    assert (row["granted_mb"], row["used_mb"], row["reason"]) == (8, 4, reason)


@pytest.mark.parametrize("kind,mb,reason", [
    ("internal", 1000, "ok"), ("internal", 1001, "spills"), ("version", 501, "version_store"), ("user", 2001, "temporary_tables"),
])
def test_temp_space(make, kind, mb, reason):
    pages = {f"{k}_pages": 0 for k in ("user", "internal", "version", "free")} | {f"{kind}_pages": mb * 128}
    assert servers.temp_space(make(temp_file_space=[{"server_id": 1, **pages}])).first()["reason"] == reason


@pytest.mark.parametrize("value,reason", [(299, "memory_insufficient"), (300, "watch"), (999, "watch"), (1000, "ok")])
def test_page_life(make, value, reason):
    t = make(perf_counter=[{"server_id": 1, "object_name": "X:Buffer Manager", "counter_name": "page life Expectancy", "cntr_value": value},
                           {"server_id": 1, "object_name": "X:Buffer Node", "counter_name": "Page life expectancy", "cntr_value": 1}])
    assert [r["reason"] for r in servers.page_life(t).collect()] == [reason]


def test_buffer_by_database_large_cache(spark, make):
    t = make(buffer_page=[], database_dim=[])
    pages = spark.range(10001 * 128).selectExpr("1L AS server_id", "7L AS database_id", "id AS page_id")
    row = servers.buffer_by_database(t.replaced(buffer_page=pages)).first()
    assert (row["cached_mb"], row["reason"]) == (10001, "large_cache_share")


@pytest.mark.parametrize("reads,read_ms,writes,write_ms,reason", [
    (1, 50, 0, 0, "read_over_20ms"), (10, 509, 0, 0, "read_over_20ms"), (1, 51, 0, 0, "read_over_50ms"),
    (1, 21, 1, 99, "read_over_20ms"),  # the milder read rung masks the critical write rung
    (1, 20, 1, 51, "write_over_50ms"), (0, 0, 1, 21, "write_over_20ms"), (0, 999, 0, 999, "ok"),
])
def test_file_latency_uses_whole_milliseconds(make, reads, read_ms, writes, write_ms, reason):
    key = {"server_id": 1, "database_id": 5, "file_id": 1}
    t = make(file_io=[{**key, "num_of_reads": reads, "num_of_writes": writes, "io_stall_read_ms": read_ms,
                       "io_stall_write_ms": write_ms, "num_of_bytes_read": 0, "num_of_bytes_written": 0}], file_dim=[key])
    assert storage.file_latency(t).first()["reason"] == reason


@pytest.mark.parametrize("log,data,reason", [(100, 100, "ok"), (101, 100, "log_over_data"), (200, 100, "log_over_data"), (201, 100, "log_over_twice_data")])
def test_log_versus_data(make, log, data, reason):
    files = [{"server_id": 1, "database_id": 5, "file_id": k, "type": k, "size_pages": p} for k, p in ((0, data), (1, log))]
    t = make(file_dim=files, database_dim=[{"server_id": 1, "database_id": 5, "name": "d", "state_desc": "ONLINE"}])
    assert storage.log_versus_data(t).first()["reason"] == reason


@pytest.mark.parametrize("n,reason", [(200, "ok"), (201, "above_recommended"), (1000, "above_recommended"), (1001, "severe_fragmentation")])
def test_log_segments(make, n, reason):
    t = make(log_vlf=[{"server_id": 1, "database_id": 5, "vlf_id": i, "vlf_active": i % 2, "vlf_size_kb": 1024} for i in range(n)], database_dim=[])
    assert storage.log_segments(t).first()["reason"] == reason
    assert float(storage.log_segment_size(t).first()["total_mb"]) == n


def test_io_share_over_seventy_percent(make):
    def io(db, reads, writes):
        return {"server_id": 1, "database_id": db, "file_id": db, "num_of_reads": reads, "num_of_writes": writes,
                "num_of_bytes_read": 1, "num_of_bytes_written": 1}

    t = make(file_io=[io(5, 71, 0), io(6, 29, 100), io(7, 0, 0)],
             database_dim=[{"server_id": 1, "database_id": d, "name": str(d)} for d in (5, 6, 7)])
    assert graded(storage.io_share(t), "database_id") == {5: "dominates_reads", 6: "dominates_writes", 7: "ok"}


def test_wait_shares_sum_to_one_hundred(telemetry):
    # 29 wait types at most, so the twenty largest do not cover all: rank without a limit
    rows = waiting.wait_ranking(telemetry, top=1000).groupBy("server_id").sum("share_pct").collect()
    assert all(abs(float(r[1]) - 100) < 0.5 for r in rows)


@pytest.mark.parametrize("seeks,lookups,updates,reason", [
    (None, None, None, "no_usage_since_restart"), (0, 0, 10001, "write_cost_only"), (0, 0, 10000, "little_used"),
    (5000, 10001, 0, "many_lookups"), (1001, 0, 0, "well_used"), (1000, 0, 0, "used"), (101, 0, 0, "used"), (100, 0, 0, "little_used"),
])
def test_unused_indexes(make, seeks, lookups, updates, reason):
    index = {"server_id": 1, "database_id": 5, "table_name": "t", "index_id": 1, "index_name": "i", "type_desc": "NONCLUSTERED",
             "is_primary_key": 0, "is_unique_constraint": 0, "is_disabled": 0}
    usage = [] if seeks is None else [{"server_id": 1, "index_id": 1, "user_seeks": seeks, "user_scans": 0,
                                       "user_lookups": lookups, "user_updates": updates}]
    t = make(index_dim=[index], index_usage=usage, server_info=[{"server_id": 1, "start_time": NOW - timedelta(days=3)}])
    assert indexes.unused_indexes(t).first()["reason"] == reason
    gate = indexes.safe_drop_gate(t, NOW).first()
    assert gate["drop_allowed"] == 0  # three days are no business cycle
    assert gate["gate"] == ("wait_for_full_cycle" if reason == "write_cost_only" else "not_a_candidate")


@pytest.mark.parametrize("tenths,pages,action", [
    (99, 5000, "NONE"), (100, 5000, "REORGANIZE"), (101, 5000, "REORGANIZE"), (299, 5000, "REORGANIZE"), (300, 5000, "REBUILD"), (301, 5000, "REBUILD"), (900, 99, "NONE"), (900, 100, "REBUILD"),
])
def test_maintenance_plan(make, tenths, pages, action):
    key = {"server_id": 1, "database_id": 5, "index_id": 1}
    t = make(index_physical=[{**key, "fragmentation_tenths": tenths, "page_count": pages}],
             index_dim=[{**key, "table_name": "t", "index_name": "i"}],
             stats_properties=[{"server_id": 1, "database_id": 5, "stats_id": 1, "total_rows": 10_000_001, "modification_counter": 0}])
    row = indexes.maintenance_plan(t).first()
    assert (row["index_action"], row["stats_action"], row["scan_mode"]) == (action, "NONE", "SAMPLE 30 PERCENT")
    assert indexes.maintenance_plan(t, tables=["other"]).isEmpty()


def stat(**more):
    return {"server_id": 1, "database_id": 5, "stats_id": 1, "table_name": "t", "stats_name": "s", "total_rows": 200_000,
            "modification_counter": 0, "rows_sampled": 200_000, "steps": 200, "last_updated": NOW, "has_filter": 0, **more}


@pytest.mark.parametrize("more,reason", [
    ({"modification_counter": 60_001}, "changed_over_30_pct"), ({"modification_counter": 60_000}, "changed_over_20_pct"),
    ({"modification_counter": 40_000}, "changed_over_10_pct"), ({"modification_counter": 20_000, "steps": 9}, "few_steps"),
    ({"rows_sampled": 19_999, "steps": 5}, "thin_sample"), ({"last_updated": NOW - timedelta(days=15)}, "older_than_14d"),
    ({"steps": 9, "total_rows": 50_000, "rows_sampled": 50_000}, "ok"), ({}, None), ({"total_rows": 1000, "steps": 1}, None),
])
def test_statistics_diagnosis(make, more, reason):
    rows = statistics.statistics_diagnosis(make(stats_properties=[stat(**more)]), NOW).collect()
    assert [r["reason"] for r in rows] == ([] if reason is None else [reason])


@pytest.mark.parametrize("more,reason", [
    ({"modification_counter": 40_001}, "changed_over_20_pct"), ({"modification_counter": 20_001}, "changed_over_10_pct"),
    ({"modification_counter": 10_001}, "many_changes"), ({"modification_counter": 1001}, "ok"), ({"modification_counter": 1000}, None),
    ({"last_updated": NOW - timedelta(days=8)}, "older_than_7d"), ({"total_rows": 0, "modification_counter": 5000}, None),
])
def test_stale_statistics(make, more, reason):
    rows = statistics.stale_statistics(make(stats_properties=[stat(**more)]), NOW).collect()
    assert [r["reason"] for r in rows] == ([] if reason is None else [reason])


@pytest.mark.parametrize("hours,reason", [(None, "never_full"), (24, "ok"), (25, "full_over_24h"), (48, "full_over_24h"), (49, "full_over_48h")])
def test_backup_age(make, hours, reason):
    log = {"backup_set_id": 1, "server_id": 1, "database_name": "d", "type": "L", "backup_finish_date": NOW}
    full = [] if hours is None else [{**log, "backup_set_id": 2, "type": "D", "backup_finish_date": NOW - timedelta(hours=hours)}]
    assert history.backup_age(make(backupset=[log, *full]), NOW).first()["reason"] == reason


@pytest.mark.parametrize("blocked,cpu,n,reason", [(10, 300_000, 100, "ok"), (11, 0, 100, "over_10_blocked"), (0, 300_001, 100, "cpu_peak"), (0, 0, 101, "over_100_sessions")])
def test_hourly_history(make, blocked, cpu, n, reason):
    rows = [{"server_id": 1, "snapshot_ts": TS + timedelta(hours=1), "session_id": i, "cpu_time": cpu,
             "blocking_session_id": 9 if i < blocked else 0} for i in range(n)]
    row = history.hourly_sessions(make(log_session=rows), NOW).first()
    assert (row["sessions"], row["blocked"], row["reason"]) == (n, blocked, reason)


def test_procedures_totals_and_reads_rung(make):
    # 10,000 runs of 100 ms are 1,000 s in total
    base = {"server_id": 1, "database_id": 5, "object_id": 1, "proc_name": "p", "execution_count": 10_000,
            "total_worker_time": 10_000 * 100_000, "total_elapsed_time": 0, "total_logical_reads": 10_000 * 100_001}
    t = make(proc_stats=[base, {**base, "object_id": 2, "proc_name": None}], database_dim=[])
    row = workload.procedure_ranking(t).collect()
    assert [(r["avg_cpu_us"], r["total_cpu_us"], r["reason"]) for r in row] == [(100_000, 1_000_000_000, "avg_reads_high")]
    assert workload.procedure_cpu(t).first()["reason"] == "ok"


def store(make, runs, plans=((1, 1),)):
    """Query Store tables: runs are (plan_id, start, duration, executions)."""
    starts = sorted({s for _, s, _, _ in runs})
    ids = {s: i for i, s in enumerate(starts)}
    return make(
        qs_runtime=[{"server_id": 1, "runtime_id": i, "plan_id": p, "interval_id": ids[s], "avg_duration": d, "avg_cpu_time": d,
                     "avg_logical_io_reads": 10, "count_executions": n, "last_execution_time": s} for i, (p, s, d, n) in enumerate(runs)],
        qs_interval=[{"server_id": 1, "interval_id": i, "start_time": s} for s, i in ids.items()],
        qs_plan=[{"server_id": 1, "plan_id": p, "query_id": q} for p, q in plans],
        qs_query=[{"server_id": 1, "query_id": q, "query_text_id": q} for q in {q for _, q in plans}],
        qs_text=[{"server_id": 1, "query_text_id": q, "query_sql_text": "select"} for q in {q for _, q in plans}],
    )


@pytest.mark.parametrize("plans,us,reason", [(3, 5_000_000, "over_1s"), (4, 1, "many_plans"), (1, 5_000_001, "over_5s"), (1, 1_000_000, "ok")])
def test_top_duration(make, plans, us, reason):
    t = store(make, [(p, TS, us, 1) for p in range(plans)], [(p, 1) for p in range(plans)])
    assert query_store.top_duration(t, NOW).first()["reason"] == reason


def test_top_duration_weights_on_request(make):
    t = store(make, [(1, TS, 100_000, 1), (1, TS + timedelta(hours=1), 400_000, 2)])
    assert float(query_store.top_duration(t, NOW).first()["avg_duration_ms"]) == 250
    assert float(query_store.top_duration(t, NOW, weighted=True).first()["avg_duration_ms"]) == 300


def test_regression_border_interval_counts_twice(make):
    border = NOW - timedelta(hours=1)
    t = store(make, [(1, border, 900, 1), (1, border - timedelta(hours=2), 100, 1)])
    row = query_store.regressions(t, NOW).first()
    assert (float(row["history_ms"]), float(row["factor"])) == (0.5, 1.8)  # history averages 900 and 100
    assert float(query_store.regressions(t, NOW, half_open=True).first()["factor"]) == 9.0


def test_pairs_multiply_where_periods_do_not(make):
    recent, past = NOW - timedelta(minutes=30), NOW - timedelta(hours=5)
    runs = [(1, recent + timedelta(minutes=i), 1000, 1) for i in range(3)] + [(1, past + timedelta(minutes=i), 100, 1) for i in range(4)]
    t = store(make, runs)
    assert query_store.regression_pairs(t, NOW).count() == 12
    assert query_store.regressions(t, NOW).count() == 1


def test_pair_pruning_is_exact_with_ties_and_zero_history(make):
    recent, past = NOW - timedelta(minutes=50), NOW - timedelta(hours=9)
    runs = [(1, recent + timedelta(minutes=i), 1000 + i // 2, 1) for i in range(9)]
    runs += [(1, past + timedelta(minutes=i), (i // 2) * 3, 1) for i in range(9)]
    t = store(make, runs)
    got = [(r["recent_id"], r["history_id"]) for r in query_store.regression_pairs(t, NOW, top=7).orderBy("rank").collect()]
    pairs = [(i, j, r[2], h[2]) for i, r in enumerate(runs[:9]) for j, h in enumerate(runs[9:], 9) if r[2] > 2 * h[2]]
    from decimal import ROUND_HALF_UP, Decimal

    def order(p):
        factor = None if p[3] == 0 else (Decimal(p[2]) / p[3]).quantize(Decimal("0.01"), ROUND_HALF_UP)
        return (factor is None, -(factor or 0), -p[2], p[0], p[3], p[1])

    assert got == [(p[0], p[1]) for p in sorted(pairs, key=order)[:7]]
