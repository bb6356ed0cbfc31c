"""Blocking chains: who leads them, and which waits are mutual."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetgauge.functions.timeunits import instant
from fleetgauge.operators.waits_for import per_snapshot
from fleetgauge.sources.telemetry import Telemetry, snapshot_keys


def blocking_edges(t: Telemetry) -> DataFrame:
    """Every distinct pair of a blocked session and one that blocks it.

    A session that waits for itself (a usual display of latch waits) is no edge.
    """
    requests = t["request_snapshot"]
    keys = snapshot_keys(requests)
    blocker = F.col("blocking_session_id")
    return (
        requests.where((blocker > 0) & (blocker != F.col("session_id")))
        .select(*keys, "session_id", blocker.alias("blocker")).distinct()
    )


def block_leaders(t: Telemetry) -> DataFrame:
    """Heads of blocking chains, with how many sessions stand behind them and how far.

    A session behind two leaders counts for both. A cycle leads the sessions that wait for
    it from outside, under its smallest member; depth is in hops, by the shortest way.
    """
    edges = blocking_edges(t)
    keys = snapshot_keys(edges)
    return per_snapshot(edges, keys, "session_id", "blocker", leaders=True).select(
        *keys, F.col("leader").alias("leader_session_id"), F.col("behind").alias("blocked_sessions"),
        F.col("hops").alias("chain_depth"),
    )


def mutual_waits(t: Telemetry, start: datetime, end: datetime) -> DataFrame:
    """Members of cycles of two or more sessions that wait for each other, in snapshots between two instants.

    A row for every member; ``first_session_id`` names the cycle.
    """
    edges = blocking_edges(t).where(F.col("snapshot_ts").between(instant(start), instant(end)))
    keys = snapshot_keys(edges)
    return per_snapshot(edges, keys, "session_id", "blocker", leaders=False).select(
        *keys, F.col("cycle").alias("first_session_id"), F.col("member").alias("session_id"),
        F.col("members").alias("sessions"),
    )


def mutual_wait_counts(t: Telemetry, start: datetime, end: datetime) -> DataFrame:
    """Cycles and their sessions per server in the window."""
    first = F.col("session_id") == F.col("first_session_id")
    return mutual_waits(t, start, end).groupBy("server_id").agg(
        F.count_if(first).alias("events"), F.count("*").alias("sessions")
    )


def mutual_wait_events(t: Telemetry, start: datetime, end: datetime) -> DataFrame:
    """Deadlocks as events: the same sessions waiting for each other in consecutive snapshots of a server are one.

    An event has a first and a last snapshot, and how many there are; a snapshot between
    two without this cycle parts it in two. So the number of events does not follow the
    rate at which a server is sampled. Members are sessions of one server (32,767 at most).
    """
    cycles = mutual_waits(t, start, end).groupBy("server_id", "snapshot_ts", "first_session_id").agg(
        F.array_sort(F.collect_list("session_id")).alias("members")
    )
    every = t["request_snapshot"].where(F.col("snapshot_ts").between(instant(start), instant(end))).select("server_id", "snapshot_ts").distinct()
    # the snapshots of a server in their order: a row for each, however many requests it holds
    numbered = every.withColumn("n", F.row_number().over(Window.partitionBy("server_id").orderBy("snapshot_ts")))
    same = Window.partitionBy("server_id", "members").orderBy("n")
    islands = cycles.join(numbered, ["server_id", "snapshot_ts"]).withColumn("island", F.col("n") - F.row_number().over(same))
    return islands.groupBy("server_id", "members", "island").agg(
        F.min("snapshot_ts").alias("started"), F.max("snapshot_ts").alias("ended"), F.count("*").alias("snapshots")
    ).select(
        "server_id", F.col("members")[0].alias("first_session_id"), F.size("members").cast("bigint").alias("sessions"),
        F.array_join(F.col("members").cast("array<string>"), ",").alias("members"), "started", "ended", "snapshots",
    )
