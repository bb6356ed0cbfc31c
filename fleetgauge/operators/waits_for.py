"""Who waits for whom: leaders of blocking chains and cycles, one snapshot at a time.

A snapshot of one server is one small graph: its sessions are bounded by the connections
a server admits (32,767), whatever the fleet's size, and its edges are distinct pairs of
sessions. So each snapshot is worked on by itself, with one shuffle for all.
"""

from __future__ import annotations

from collections import defaultdict, deque
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame


def components(after: dict[int, list[int]]) -> dict[int, int]:
    """Each node's strongly connected component, named by its smallest node (Tarjan, without recursion)."""
    index: dict[int, int] = {}
    low: dict[int, int] = {}
    stack: list[int] = []
    open_nodes: set[int] = set()
    named: dict[int, int] = {}
    for root in sorted(after):
        if root in index:
            continue
        work = [(root, iter(after[root]))]
        index[root] = low[root] = len(index)
        stack.append(root)
        open_nodes.add(root)
        while work:
            node, rest = work[-1]
            for other in rest:
                if other not in index:
                    index[other] = low[other] = len(index)
                    stack.append(other)
                    open_nodes.add(other)
                    work.append((other, iter(after.get(other, ()))))
                    break
                if other in open_nodes:
                    low[node] = min(low[node], index[other])
            else:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[node])
                if low[node] == index[node]:
                    members = []
                    while not members or members[-1] != node:
                        members.append(stack.pop())
                        open_nodes.discard(members[-1])
                    named |= dict.fromkeys(members, min(members))
    return named


def analyse(edges: list[tuple[int, int]]) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """((leader, sessions behind it, hops to the farthest), ...), ((cycle, member, members), ...).

    An edge goes from a session to one it waits for; one to itself says nothing and is left
    out. A leader waits for nobody, or is a cycle whose members wait for nobody else; a cycle
    is named by its smallest member. Its members are not behind it; sessions that reach it are,
    by the fewest hops.
    """
    after, before = defaultdict(list), defaultdict(list)
    for node, other in sorted(set(edges)):
        if node != other:
            after[node].append(other)
            before[other].append(node)
    named = components(after)
    members = defaultdict(list)
    for node, cycle in named.items():
        members[cycle].append(node)
    leaders = []
    for name, own in members.items():
        if any(named[o] != name for n in own for o in after.get(n, ())):
            continue
        hops = dict.fromkeys(own, 0)
        queue = deque(own)
        while queue:
            node = queue.popleft()
            for other in before.get(node, ()):
                if other not in hops:
                    hops[other] = hops[node] + 1
                    queue.append(other)
        if len(hops) > len(own):
            leaders.append((name, len(hops) - len(own), max(hops.values())))
    cycles = [(name, node, len(own)) for name, own in members.items() if len(own) > 1 for node in own]
    return sorted(leaders), sorted(cycles)


def per_snapshot(edges: DataFrame, keys, node: str, other: str, leaders: bool) -> DataFrame:
    """Leaders (leader, behind, hops), or cycles (cycle, member, members), of every snapshot.

    Snapshots are many and small, so a task walks through its sorted rows and works on one
    after the other, instead of starting a group for each.
    """
    keys = list(keys)
    names = ("leader", "behind", "hops") if leaders else ("cycle", "member", "members")
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "timestamp": pa.timestamp("us", "UTC")}
    key_types = [kinds[edges.schema[k].dataType.simpleString()] for k in keys]
    schema = ", ".join([*(f"`{k}` {edges.schema[k].dataType.simpleString()}" for k in keys), *(f"{n} bigint" for n in names)])

    def rows(batches):
        for batch in batches:
            # times as microseconds, which no time zone changes
            columns = [c.cast(pa.int64()).to_pylist() for c in batch.columns[: len(keys)]]
            yield from zip(zip(*columns), zip(batch.column(len(keys)).to_pylist(), batch.column(len(keys) + 1).to_pylist()))

    def work(batches):
        out: list[tuple] = []
        for key, group in groupby(rows(batches), key=lambda r: r[0]):
            out += [(*key, *r) for r in analyse([edge for _, edge in group])[0 if leaders else 1]]
            if len(out) >= 4096:
                yield packed(out)
                out = []
        yield packed(out)

    def packed(out):
        types = [*key_types, *[pa.int64()] * 3]
        columns = [pa.array([r[k] for r in out], pa.int64() if pa.types.is_timestamp(t) else t).cast(t) for k, t in enumerate(types)]
        return pa.RecordBatch.from_arrays(columns, names=[*keys, *names])

    sorted_edges = edges.select(*keys, node, other).distinct().repartition(*keys).sortWithinPartitions(*keys)
    return sorted_edges.mapInArrow(work, schema)
