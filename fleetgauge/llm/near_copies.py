"""Near copies by their word shingles: Jaccard similarity of `SIMILAR` or more.

A text is the set of its shingles of `SIZE` words (the whole text, if it has fewer). Three
steps find candidates, and none of them moves a set:

* Anchors (`simhash.links`) meet the fingerprints of the sets that are within two bits.
  Similar sets may well be farther apart, so the other steps follow for all sets.

* MinHash tells the sets that may have a partner at all: `BANDS` buckets of `ROWS` minima
  each, so that a pair of similarity s is missed with probability (1 - s ** ROWS) ** BANDS,
  which is 5e-8 at 0.8 and less above.
* Prefixes pair them (exact): with the shingles of every set in one order, similar sets have
  their first common shingle among the first fifth of the larger set and the first ninth of
  the smaller, and early enough in both for the overlap to be reached. The order puts
  shingles that many sets share last, so that sets with a common template, but too much
  of their own, never meet. Which shingles these are is told by one of `SAMPLE` sets; any
  order gives the same pairs in the end.

Distinct sets are compared, never copies. All sets of a prefix shingle are first compared
with the smallest, and the links found are followed to components. Only then those pairs
are compared whose ends are in different components: of a large group of near
copies few are left, and a pair within one component changes nothing. Every link is
verified on the two sets themselves.

Cases. Null, empty and white-space texts have no shingles and are copies of each other.
Empty tables give empty results.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetgauge.llm.common import KeyFilter, field, map_bodies, over_half, quoted, saved, shingle_hashes, signed
from fleetgauge.llm.components import components

SIZE, SIMILAR, BANDS, ROWS, SAMPLE = 5, 0.8, 32, 4, 64
LONGS = T.ArrayType(T.LongType())


def shingle_set(body: bytes | None) -> np.ndarray:
    """The distinct shingles as sorted signed longs."""
    return np.unique(shingle_hashes(body, SIZE).view(np.int64))


@functools.cache
def factors() -> np.ndarray:
    return np.random.default_rng(11).integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) << np.uint64(1) | np.uint64(1)


def buckets(shingles: np.ndarray) -> list[int]:
    """The buckets of a set: hashes of ROWS minima each."""
    if not len(shingles):
        return []
    u = shingles.view(np.uint64)
    low = functools.reduce(np.minimum, (np.multiply.outer(factors(), u[k : k + 4096]).min(1) for k in range(0, len(u), 4096)))
    low = low.reshape(BANDS, ROWS)
    return np.array([xxhash.xxh64_intdigest(low[k].tobytes(), k) for k in range(BANDS)], np.uint64).view(np.int64).tolist()


def name_of(own: np.ndarray) -> bytes:
    """128 bits that stand for a set."""
    return xxhash.xxh3_128_digest(own.tobytes())


def sketches(bodies: list[bytes | None]) -> list:
    sets = [shingle_set(b) for b in bodies]
    return [list(map(name_of, sets)), list(map(len, sets)), list(map(buckets, sets)), [signed(over_half(x.view(np.uint64))) for x in sets]]


def anchored(nodes: DataFrame, links: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Pairs (left, right) of nodes that may be similar by size, of the fingerprints that `links` connects.

    The sets of one fingerprint meet the smallest of them, and the smallest ones of linked fingerprints each other.
    """
    own = nodes.where("size > 0").select("fp", F.struct("size", "node").alias("set"))
    first = saved(own.groupBy("fp").agg(F.min("set").alias("first")), "first-sets")
    same = own.join(first, "fp").where("first < set").select(F.col("first").alias("a"), F.col("set").alias("b"))
    ends = [first.select(F.col("fp").alias(side), F.col("first").alias(name)) for side, name in (("left", "x"), ("right", "y"))]
    met = links(first.select("fp")).join(ends[0], "left").join(ends[1], "right")
    pairs = same.union(met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")))
    return pairs.where("a.size * 5 >= b.size * 4").select(F.col("a.node").alias("left"), F.col("b.node").alias("right"))


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= SIMILAR * (len(a) + len(b) - both)


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (left, right) of nodes that are similar by their whole sets."""

    def check(batches):
        for batch in batches:
            sides = [[x.values.to_numpy() for x in batch.column(k)] for k in (2, 3)]
            ok = pa.array([similar(a, b) for a, b in zip(*sides)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(k).filter(ok) for k in (0, 1)], names=["left", "right"])

    side = lambda name: sets.select(F.col("node").alias(name), F.col("shingles").alias(f"{name}_set"))
    joined = pairs.join(side("left"), "left").join(side("right"), "right").select("left", "right", "left_set", "right_set")
    return joined.mapInArrow(check, "left binary, right binary")


def sets_of(docs: DataFrame, keys: DataFrame, text: str) -> DataFrame:
    """node, shingles of the nodes in `keys` (node, key: the hash of one of their texts)."""
    held = docs.select(F.xxhash64(quoted(text)).alias("key"), F.col(quoted(text)).alias("body"))
    # copies are dropped before the shuffle, so that no key is hot
    once = held.groupBy("key").agg(F.first("body").alias("body")).join(keys, "key")

    def work(bodies: list[bytes | None]) -> list:
        sets = [shingle_set(b) for b in bodies]
        return [[x.tolist() for x in sets], list(map(name_of, sets))]

    made = map_bodies(once, work, [T.StructField("shingles", LONGS), field("own", "binary")], ["node"], "body")
    return made.where("own = row.node").select("row.node", "shingles").dropDuplicates(["node"])


def common(sets: DataFrame) -> KeyFilter:
    """The shingles that two sets or more of a sample share."""
    some = sets.where(F.pmod(F.xxhash64("node"), F.lit(SAMPLE)) == 0).select(F.explode("shingles").alias("shingle"))
    return KeyFilter(saved(some.groupBy("shingle").agg(F.count("*").alias("n")).where("n > 1").select("shingle"), "common"), "shingle")


def prefixes(sets: DataFrame, last: KeyFilter) -> DataFrame:
    """shingle, node, size, at (place in the order) of the first fifth of every set; `smaller` marks the first ninth."""

    def emit(batches):
        for batch in batches:
            rows, at, found, sizes = [], [], [], []
            for k, own in enumerate(batch.column(1)):
                x = own.values.to_numpy()
                n = len(x)
                first = n + (-4 * n // 5) + 1  # n - ceil(4 n / 5) + 1
                order = np.lexsort((x, last.holds(x)))[:first]
                found.append(x[order])
                at.append(np.arange(first))
                rows.append(np.full(first, k))
                sizes.append(np.full(first, n))
            if rows:
                place, n = np.concatenate(at), np.concatenate(sizes)
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.concatenate(found)), batch.column(0).take(pa.array(np.concatenate(rows))), pa.array(n.astype(np.int32)),
                    pa.array(place.astype(np.int32)), pa.array(place <= n + (-8 * n // 9)),
                ], names=["shingle", "node", "size", "at", "smaller"])

    made = sets.where(F.size("shingles") > 0).select("node", "shingles")
    return made.mapInArrow(emit, "shingle bigint, node binary, size int, at int, smaller boolean")


def may_be_similar(size: str, at: str, other_size: str, other_at: str):
    """Whether sizes, and what follows a common shingle in both, allow for the similarity if it is the first common one."""
    a, b = F.col(size), F.col(other_size)
    rest = F.least(a - F.col(at), b - F.col(other_at))
    return (F.least(a, b) * 5 >= F.greatest(a, b) * 4) & (rest * 9 >= (a + b) * 4)


def rooted(wanted: DataFrame, docs: DataFrame, text: str, pairs: DataFrame) -> DataFrame:
    """node, root for the nodes with a similar one; `wanted` has node and key of those that may have one, `pairs` are tried first."""
    sets = saved(sets_of(docs, wanted, text), "shingle-sets")
    placed = saved(prefixes(sets, common(sets)), "prefixes")
    shared = placed.groupBy("shingle").agg(F.count("*").alias("n"), F.min(F.when(F.col("smaller"), F.struct("size", "node", "at"))).alias("low"))
    shared = shared.where("n > 1 and low is not null")
    members = placed.join(shared, "shingle")
    order = F.struct("size", "node") > F.struct("low.size", "low.node")
    tried = saved(
        members.where(order & may_be_similar("size", "at", "low.size", "low.at")).select(F.col("low.node").alias("left"), F.col("node").alias("right")).union(pairs).distinct(),
        "tried",
    )
    links = saved(verified(tried, sets), "near-links")
    known = components(links, "left", "right")
    labelled = members.drop("low", "n").join(known, "node", "left").withColumn("root", F.coalesce("root", "node"))
    labelled = saved(labelled, "labelled")
    mixed = labelled.groupBy("shingle").agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a != b").select("shingle")
    open_ = labelled.join(mixed, "shingle", "left_semi")
    smaller = open_.where("smaller").select("shingle", *[F.col(c).alias(f"_{c}") for c in ("node", "size", "at", "root")])
    rest = (
        open_.join(smaller, "shingle")
        .where((F.struct("size", "node") > F.struct("_size", "_node")) & (F.col("root") != F.col("_root")) & may_be_similar("size", "at", "_size", "_at"))
        .select(F.col("_node").alias("left"), F.col("node").alias("right")).distinct().join(tried, ["left", "right"], "left_anti")
    )
    more = saved(verified(rest, sets), "more-links")
    return known if more.isEmpty() else components(links.union(more), "left", "right")


def near_copies(docs: DataFrame, carry: list[str], text: str, links: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """`row` (the carried columns) and `component`, the same for all texts that similar ones connect.

    `links` gives pairs `left`, `right` of near fingerprints (column `fp`).
    """
    fields = [field("node", "binary"), field("size", "int"), T.StructField("buckets", LONGS), field("fp", "bigint")]
    marked = saved(map_bodies(docs.withColumn("_key", F.xxhash64(quoted(text))), sketches, fields, [*carry, "_key"], text), "sketches")
    nodes = marked.groupBy("node").agg(*[F.first(c).alias(c) for c in ("size", "buckets", "fp")], F.min("row._key").alias("key"))
    nodes = saved(nodes, "nodes")
    placed = nodes.select("node", "key", F.explode("buckets").alias("bucket"))
    shared = placed.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1").select("bucket")
    pairs = saved(anchored(nodes, links), "anchored")
    ends = nodes.join(pairs.select(F.explode(F.array("left", "right")).alias("node")), "node", "left_semi")
    wanted = placed.join(shared, "bucket", "left_semi").select("node", "key").union(ends.select("node", "key"))
    roots = saved(rooted(saved(wanted.distinct(), "members"), docs, text, pairs), "roots")
    row = F.struct(*[F.col(f"row.{quoted(c)}").alias(c) for c in carry]).alias("row")
    return marked.join(roots, "node", "left").select(row, F.coalesce("root", "node").alias("component"))
