"""SimHash near-duplicates by anchor points of a covering code.

Fingerprints of 64 bits link at two or fewer differing bits. Anchors are the words of a
covering code over the first 46 bits: two blocks of 23 bits, each covered by the perfect
binary Golay code (4,096 words, covering radius 3), so 2 ** 24 anchors. Every fingerprint
has exactly one home anchor, at most 3 bits away in each block. A fingerprint y within two
bits of x lies within 3 + e1 and 3 + e2 of x's home with e1 + e2 <= 2, so it is replicated
to all those anchors (61 on average, whatever the input), and every pair meets at the home
of either of its ends. At an anchor the homes are compared with the replicas by the whole
64 bits.

Distinct fingerprints are compared, never copies. Where an anchor is the home of more
than `CROWD` fingerprints (a large group of near copies), comparing all of them would be
quadratic. The fingerprints that reach such an anchor are linked through points instead:
two of them are within two bits exactly if they share a point within one bit of both, and
all that share a point are within two bits of each other, so a link to the smallest at
each point (65 points for each) loses none of their connections. Both ways are exact, so
that the switch changes the plan only, never the result.

Replicas and points are many times the rows of their input. Spark takes them for as few,
and would broadcast them where the fingerprints alone are small; their joins ask for a
merge of shuffled rows, so that no more than a part of them is ever in one place.

Cases. Null, empty and white-space texts have fingerprint zero and are linked like any
other; texts of one or two words hash as one shingle. Equal rows share fingerprint and
component. A component whose doc_ids are all null has a null component_id. Empty tables
give empty results.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetgauge.llm.common import columns, field, map_bodies, over_half, quoted, saved, shingle_hashes, signed, unpacked
from fleetgauge.llm.components import components
from fleetgauge.llm.near_copies import near_copies

THRESHOLD, CROWD = 2, 64
BLOCK = 23
#: Fixed value: generator polynomial of the binary Golay code, x^11+x^9+x^7+x^6+x^5+x+1.
GENERATOR = 0b101011100011

def fingerprint(body: bytes | None, size: int = 3) -> int:
    """Unsigned SimHash of the text's word shingles of this size."""
    return over_half(shingle_hashes(body, size))


def fingerprints(docs: DataFrame, carry: list[str] | None = None, text: str = "text", size: int = 3) -> DataFrame:
    """`row` (the carried columns) and `fp`, the fingerprint as a signed long."""
    return map_bodies(docs, lambda bodies: [[signed(fingerprint(b, size)) for b in bodies]], [field("fp", "bigint")], carry, text)


@functools.cache
def golay() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Tables of the code: each 23-bit word's syndrome; by syndrome the start, count and list of error patterns of up to five bits.

    Patterns of a syndrome are in order of weight: a word plus a pattern of its syndrome is
    a code word at that distance.
    """
    words = np.arange(1 << BLOCK, dtype=np.uint32)
    rest = words.copy()
    for k in range(BLOCK - 1, 10, -1):
        rest = np.where(rest >> np.uint32(k) & np.uint32(1), rest ^ np.uint32(GENERATOR << (k - 11)), rest)
    syndrome = rest.astype(np.uint16)
    weight = np.bitwise_count(words)
    near = words[weight <= 3 + THRESHOLD]
    order = np.lexsort((near, weight[near], syndrome[near]))
    patterns = near[order].astype(np.int64)
    counts = np.bincount(syndrome[patterns], minlength=1 << 11)
    return syndrome, np.concatenate([[0], np.cumsum(counts)[:-1]]), counts, patterns


def block_anchors(words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each 23-bit word: row numbers, anchors within five bits, and by how much each is beyond three."""
    syndrome, start, count, patterns = golay()
    s = syndrome[words]
    n = count[s]
    rows = np.repeat(np.arange(len(words)), n)
    at = np.arange(len(rows)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(start[s], n)
    beyond = np.maximum(np.bitwise_count(patterns[at].astype(np.uint32)).astype(np.int64) - 3, 0)
    return rows, words[rows] ^ patterns[at], beyond


def anchors_of(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, anchor, is home) of every anchor that a fingerprint is replicated to."""
    u = fps.astype(np.int64).view(np.uint64)
    low = (u & np.uint64((1 << BLOCK) - 1)).astype(np.int64)
    high = (u >> np.uint64(BLOCK) & np.uint64((1 << BLOCK) - 1)).astype(np.int64)
    r1, a1, b1 = block_anchors(low)
    r2, a2, b2 = block_anchors(high)
    n2 = np.bincount(r2, minlength=len(fps))
    first2 = np.cumsum(n2) - n2
    reps = n2[r1]
    left = np.repeat(np.arange(len(r1)), reps)
    right = np.arange(len(left)) - np.repeat(np.cumsum(reps) - reps, reps) + np.repeat(first2[r1], reps)
    keep = b1[left] + b2[right] <= THRESHOLD
    left, right = left[keep], right[keep]
    return r1[left], a1[left] << BLOCK | a2[right], (b1[left] == 0) & (b2[right] == 0)


REPLICAS = T.StructType([field("anchor", "bigint"), field("fp", "bigint"), field("home", "boolean")])


def replicate(batches):
    for batch in batches:
        fps = batch.column(0).to_numpy(zero_copy_only=False)
        for k in range(0, len(fps), 1024):
            rows, anchors, home = anchors_of(fps[k : k + 1024])
            yield pa.RecordBatch.from_arrays([pa.array(anchors), pa.array(fps[k : k + 1024][rows]), pa.array(home)], names=REPLICAS.names)


def links(distinct: DataFrame) -> DataFrame:
    """Pairs `left` < `right` of distinct fingerprints that connect all within THRESHOLD bits (column `fp`, no repeats)."""
    replicas = distinct.select("fp").mapInArrow(replicate, REPLICAS)
    homes = saved(replicas.where("home").select("anchor", F.col("fp").alias("left")), "homes")
    crowded = saved(homes.groupBy("anchor").count().where(F.col("count") > CROWD).select("anchor"), "crowded")
    lone = homes.join(crowded, "anchor", "left_anti")
    differing = F.bit_count(F.col("left").bitwiseXOR(F.col("right")))
    compared = (
        lone.join(replicas.select("anchor", F.col("fp").alias("right")).hint("merge"), "anchor")
        .where((F.col("left") < F.col("right")) & (differing <= THRESHOLD))
        .select("left", "right").distinct()
    )
    if crowded.isEmpty():
        return compared
    near = saved(replicas.join(crowded, "anchor", "left_semi").select("fp").distinct(), "crowds")
    flips = [F.col("fp").bitwiseXOR(F.lit(v).cast("bigint")) for v in (0, *(signed(1 << k) for k in range(64)))]
    points = near.select("fp", F.explode(F.array(*flips)).alias("point"))
    smallest = points.groupBy("point").agg(F.min("fp").alias("left"))
    shared = points.hint("merge").join(smallest, "point").where("left < fp").select("left", F.col("fp").alias("right")).distinct()
    return compared.union(shared)


def near_duplicates(docs: DataFrame, ids: str = "doc_id", carry: list[str] | None = None, text: str = "text") -> DataFrame:
    """`row`, `fp` and `component_id`, the smallest id among all documents that links connect."""
    marked = saved(fingerprints(docs, carry, text), "fingerprints")
    distinct = saved(marked.groupBy("fp").agg(F.min(F.col("row").getField(ids)).alias("first")), "distinct")
    rooted = saved(components(links(distinct), "left", "right"), "rooted")
    named = distinct.join(rooted.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    smallest = named.groupBy("root").agg(F.min("first").alias("component_id"))
    by_fp = named.select("fp", "root").join(smallest, "root")
    return marked.join(by_fp, "fp").select("row", "fp", "component_id")


def simhash_report(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id."""
    return unpacked(near_duplicates(docs, carry=["doc_id"]), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, ids: str = "doc_id", text: str = "text") -> DataFrame:
    """Of each group of near copies the document with the smallest (id, text hash), a null id last; of rows that repeat it whole, one.

    Near copies are those of `near_copies` (five words, Jaccard). Fingerprints of five words meet at the anchors
    first; what they link is verified, and pairs beyond two bits are found by `near_copies` alone.
    """
    source = docs.select(F.col(quoted(ids)).alias("id"), F.xxhash64(quoted(text)).alias("key"), F.col(quoted(text)).alias("body"))
    grouped = near_copies(source, ["id", "key"], "body", links)
    order = F.struct(F.col("row.id").isNull(), F.col("row.id"), F.col("row.key"))
    counted = grouped.groupBy("component", "row").agg(F.count("*").alias("n"))
    first = counted.groupBy("component").agg(F.min_by(F.struct("row", "n"), order).alias("first"))
    kept = saved(first.select(F.col("first.row.id").alias("_id"), F.col("first.row.key").alias("_key"), F.col("first.n").alias("n")), "kept")
    held = docs.select(F.struct(*columns(docs)).alias("row"), F.col(quoted(ids)).alias("own"), F.xxhash64(quoted(text)).alias("own_key"))
    joined = held.join(kept, F.col("own").eqNullSafe(F.col("_id")) & (F.col("own_key") == F.col("_key")))
    single = unpacked(joined.where("n = 1"))
    if kept.where("n > 1").isEmpty():
        return single
    return single.union(unpacked(joined.where("n > 1").dropDuplicates(["_id", "_key"])))
