"""Sharding by balanced label propagation.

Documents with equal texts are one node, as heavy as its documents. Nodes are linked
through hubs: the hashes of all their lines with a word, so that any shared line links.
A hub that one node has alone links nothing. Labels are shards. They start from the node's
first hub, the one with the fewest nodes, which puts most linked documents together. Each round, hubs add up the labels of their nodes, every node
asks for the label that most of its neighbours (itself left out) have, and requests are
granted where they gain most, as far as quotas allow: a shard takes in no more than what
leaves it plus its room below the capacity. Quotas are cut at bands of gain and a hash of
the node, so that granting is a join with a small table; its size depends on shards and
bands only.

The law is `rows`: after the last round, all documents are put in one order, by label,
then by cell, and cut into shards whose counts differ by one at most. Labels are nearly
even by then, so few documents move in this cut. A cell holds about `CELL` documents of
one label, with those of one first hub together; a hub too large for one cell is spread
over several by a hash of the document, so that ordering within cells never meets a hot
group whole.

Nothing is gathered by a hot key: the sums of a hub by label are few, and its nodes hear them
in salts of about `HOT`; rows that repeat another whole are numbered before they are placed.

Cases. A null text is as empty: size 1, checksum 0. Repeated rows are of one node and take
places of their own. Null ids order first. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetgauge.llm.common import quoted, saved

SHARDS, ROUNDS, CAPACITY, CELL = 16, 4, 1.03, 4096
BANDS, STEPS = 16, 16
#: Nodes of one hub that one task hears at least.
HOT = 512
#: A line counts if it has more than white space.
WORD = r"[^\x20\x09-\x0D]"


def sketched(docs: DataFrame, ids: str = "doc_id", text: str = "text") -> DataFrame:
    """id, size, text_crc32, node, hubs of every row."""
    body = F.coalesce(F.col(quoted(text)), F.lit(""))
    lines = F.filter(F.split(body, "\n", -1), lambda x: x.rlike(WORD))
    return docs.select(
        F.col(quoted(ids)).cast("bigint").alias("id"), (F.octet_length(body) + 1).cast("bigint").alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"), F.xxhash64(body).alias("node"),
        F.array_distinct(F.transform(lines, lambda x: F.xxhash64(x))).alias("hubs"),
    )


def salted(edges: DataFrame, *more: str) -> DataFrame:
    """node, hub, salt, salts: the nodes of a large hub are spread over salts of about `HOT` nodes."""
    if "n" not in edges.columns:
        edges = edges.join(edges.groupBy("hub").agg(F.count("*").alias("n")), "hub")
    salts = F.ceil(F.col("n") / HOT).cast("int")
    return edges.select("node", "hub", *more, F.pmod(F.xxhash64(F.lit(13), "node"), salts).cast("int").alias("salt"), salts.alias("salts"))


def votes(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """node, wish, gain: the label most of a node's neighbours have, and by how much more than its own.

    A hub's sums by label are few; each of its salts gets a copy of them.
    """
    labelled = edges.join(labels, "node")
    heard = labelled.groupBy("hub", "label").agg(F.sum("weight").alias("votes"), F.first("salts").alias("salts"))
    heard = heard.select("hub", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.col("label").alias("wish"), "votes")
    seen = (
        labelled.select("hub", "salt", "node", "label", "weight").join(heard, ["hub", "salt"])
        .groupBy("node", "wish").agg(F.sum(F.col("votes") - F.when(F.col("wish") == F.col("label"), F.col("weight")).otherwise(0)).alias("votes"), F.first("label").alias("label"))
    )
    best = seen.groupBy("node").agg(
        F.max_by("wish", F.struct("votes", (F.col("wish") == F.col("label")).cast("int").alias("stay"), "wish")).alias("wish"),
        F.max("votes").alias("most"), F.max(F.when(F.col("wish") == F.col("label"), F.col("votes")).otherwise(0)).alias("own"),
    )
    return best.select("node", "wish", (F.col("most") - F.col("own")).alias("gain"))


def granted(requests: DataFrame, loads: dict[int, int], capacity: int) -> list[tuple[int, int, int]]:
    """(from, to, first rank that stays) for each pair of shards, from the weights by rank of gain.

    `requests` has source, target, rank, weight with few ranks: at most shards ** 2 * BANDS * STEPS rows.
    """
    rows: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for r in requests.collect():
        rows.setdefault((r["source"], r["target"]), []).append((r["rank"], int(r["weight"])))
    asked = {pair: sum(w for _, w in x) for pair, x in rows.items()}
    moved = {pair: min(w, asked.get(pair[::-1], 0)) for pair, w in asked.items()}  # swaps keep both sizes
    room = {k: max(0, capacity - n) for k, n in loads.items()}
    for pair in sorted(asked, key=lambda p: (-asked[p], p)):
        more = min(asked[pair] - moved[pair], room.get(pair[1], 0))
        moved[pair] += more
        room[pair[1]] = room.get(pair[1], 0) - more
    cuts = []
    for pair, x in rows.items():
        total, stop = 0, -1
        for rank, weight in sorted(x):
            if total + weight > moved[pair]:
                break
            total, stop = total + weight, rank
        cuts.append((*pair, stop + 1))
    return cuts


def propagate(nodes: DataFrame, edges: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """node, weight, first, label after the rounds."""
    spark = nodes.sparkSession
    edges = edges if "salt" in edges.columns else saved(salted(edges), "salted")
    labels = saved(nodes.withColumn("label", F.pmod(F.xxhash64(F.lit(3), "first"), F.lit(shards)).cast("int")), "labels")
    for _ in range(rounds):
        loads = {r["label"]: int(r["n"]) for r in labels.groupBy("label").agg(F.sum("weight").alias("n")).collect()}
        total = sum(loads.values())
        capacity = int(total / shards * CAPACITY) + 1
        wishes = votes(edges, labels.select("node", "weight", "label"))
        band = F.least(F.lit(BANDS - 1), F.log2(F.col("gain").cast("double")).cast("int"))
        asks = labels.join(wishes, "node").where((F.col("wish") != F.col("label")) & (F.col("gain") > 0)).select(
            "node", "weight", F.col("label").alias("source"), F.col("wish").alias("target"),
            ((BANDS - 1 - band) * STEPS + F.pmod(F.xxhash64(F.lit(5), "node"), F.lit(STEPS))).cast("int").alias("rank"),
        )
        asks = saved(asks, "asks")
        cuts = granted(asks.groupBy("source", "target", "rank").agg(F.sum("weight").alias("weight")), {k: loads.get(k, 0) for k in range(shards)}, capacity)
        if not any(stop for *_, stop in cuts):
            break
        table = spark.createDataFrame(cuts, "source int, target int, stop int")
        moves = asks.join(F.broadcast(table), ["source", "target"]).where("rank < stop").select("node", F.col("target").alias("move"))
        labels = saved(labels.join(moves, "node", "left").select("node", "weight", "first", F.coalesce("move", "label").alias("label")), "labels")
    return labels


def running(cells: DataFrame, group: list[str], by: str) -> DataFrame:
    """Adds to `start` the documents of the same group that stand before, in the order of `by`; sums come first, so that no window holds more than a group's."""
    sums = cells.groupBy(*group, by).agg(F.sum("n").alias("sum"))
    before = Window.partitionBy(*group).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)  # without a group: a row for each shard
    offsets = sums.select(*group, by, F.coalesce(F.sum("sum").over(before), F.lit(0)).alias("more"))
    start = F.col("start") if "start" in cells.columns else F.lit(0).cast("bigint")
    others = [c for c in cells.columns if c != "start"]
    return cells.join(offsets, [*group, by]).select(*others, (start + F.col("more")).alias("start"))


def shard(docs: DataFrame, ids: str = "doc_id", text: str = "text", shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """id, size, text_crc32, label, shard, slot: a row for every document."""
    rows = saved(sketched(docs, ids, text), "sketched")
    nodes = saved(rows.groupBy("node").agg(F.count("*").alias("weight"), F.first("hubs").alias("hubs")), "nodes")
    hubs = nodes.select("node", F.explode("hubs").alias("hub"))
    shared = hubs.groupBy("hub").agg(F.count("*").alias("n")).where("n > 1")
    linked = hubs.join(shared, "hub")
    edges = saved(salted(linked, "n"), "edges")
    # the hub that links a node to the fewest others, else the node stands for itself
    first = edges.groupBy("node").agg(F.min_by("hub", F.struct("n", "hub")).alias("first"))
    known = nodes.select("node", "weight").join(first, "node", "left").select("node", "weight", F.coalesce("first", "node").alias("first"))
    labels = propagate(known, edges.drop("n"), shards, rounds)
    # rows that repeat another whole are numbered, so that they part as any others
    numbered = rows.groupBy("id", "size", "text_crc32", "node").agg(F.count("*").alias("n"))
    numbered = numbered.select("id", "size", "text_crc32", "node", F.explode(F.sequence(F.lit(1).cast("bigint"), "n")).alias("copy"))
    placed = numbered.join(labels.select("node", "first", "label"), "node")
    total = rows.count()
    parts = max(1, -(-total // (shards * CELL)))
    placed = placed.withColumn("part", F.pmod(F.xxhash64(F.lit(7), "first"), F.lit(parts)).cast("int"))
    heavy = placed.groupBy("label", "part").agg(F.count("*").alias("n")).select("label", "part", F.ceil(F.col("n") / CELL).cast("int").alias("salts"))
    placed = placed.join(saved(heavy, "cells", small=True), ["label", "part"]).withColumn("salt", F.pmod(F.xxhash64(F.lit(9), "id", "node", "copy"), "salts").cast("int"))
    placed = saved(placed.select("id", "size", "text_crc32", "node", "copy", "first", "label", "part", "salt"), "placed")
    cell = ["label", "part", "salt"]
    sizes = saved(placed.groupBy(*cell).agg(F.count("*").alias("n")), "cell-sizes", small=True)  # one row for every CELL documents or so
    starts = running(running(running(sizes, ["label", "part"], "salt"), ["label"], "part"), [], "label")
    inside = F.row_number().over(Window.partitionBy(*cell).orderBy("first", "node", "id", "size", "copy")) - 1
    ordered = placed.join(starts.drop("n"), cell).withColumn("place", F.col("start") + inside)
    least, extra = divmod(total, shards)
    wide = extra * (least + 1)  # documents of the shards that hold one more
    place = F.col("place")
    if least == 0:
        where, slot = place, F.lit(0)
    else:
        where = F.when(place < wide, F.floor(place / (least + 1))).otherwise(extra + F.floor((place - wide) / least))
        slot = F.when(place < wide, place % (least + 1)).otherwise((place - wide) % least)
    return ordered.select("id", "size", "text_crc32", "label", where.cast("int").alias("shard"), slot.cast("bigint").alias("slot"))


def sharding_report(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard (null under this law), and the label before the last cut."""
    return shard(docs).select(
        F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "label",
    )

