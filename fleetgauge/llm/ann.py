"""Nearest neighbours by collision counting over query-centred windows.

Every vector is projected on `PROJECTIONS` random directions. For each direction the
vectors are a sorted array, and a query collides with a vector there if the two
projections lie within half a window. At radius R the half window is R times `WINDOW`;
virtual rehashing enlarges R by `GROWTH` and only reads what the wider window adds on
either side. A vector that collides in at least `THRESHOLD` of the directions is a
candidate: its exact distance is computed in double precision from the original vectors. A
vector at distance R or less reaches the threshold with high probability, so a query
stops at the first R that is not below the distance of its k-th nearest candidate, or when
every vector is a candidate.

Vectors are dealt into blocks, each of which is shuffled once, to one task, which sorts its
projections once. The queries follow in batches: a task holds one block (`ENTRIES` numbers
and its arrays) and one batch. Each query gets the k nearest of each block; the k nearest of
all follow from at most k rows a block. Nothing is broadcast.

Cases. Vectors that are null, empty, zero, or with null or non-finite components take no
part, as queries or as candidates. Vectors of different lengths are neighbours only of those
of their own length. A query's own row is no candidate; other rows with its id or an equal
vector are, at distance zero if equal. Rows that repeat another whole are one in the arrays
with their number, and come back as often as they are there; such queries are one query.
One id with two vectors is two queries. Ties go to the smaller id, null ids last. With
fewer than k candidates all are returned. Where projections leave the range of doubles, a
block is compared row by row; a distance beyond it is infinite. Empty tables give empty results.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetgauge.llm.common import quoted, saved

NEAREST, PROJECTIONS, WINDOW, GROWTH, DEVIATIONS = 10, 64, 1.0, 1.15, 1.8
#: Numbers in the vectors of one block, rows of one at most, and rows of the smallest worth a task.
ENTRIES, BLOCK, LEAST, SEED = 1 << 22, 65_536, 4096, 20240

#: Chance that two vectors at distance R collide in one direction when the half window is R * WINDOW.
CHANCE = 0.682689
THRESHOLD = PROJECTIONS * CHANCE - DEVIATIONS * (PROJECTIONS * CHANCE * (1 - CHANCE)) ** 0.5


def directions(size: int) -> np.ndarray:
    return np.random.default_rng(SEED).standard_normal((size, PROJECTIONS))


class Index:
    """Sorted projections of a block of vectors, in the order of their ids, null ids last; `copies` says how often each is there."""

    def __init__(self, ids: np.ndarray, nulls: np.ndarray, vectors: np.ndarray, copies: np.ndarray):
        order = np.lexsort((ids, nulls))
        self.ids, self.nulls, self.vectors, self.copies = ids[order], nulls[order], vectors[order], copies[order]
        self.a = directions(vectors.shape[1])
        with np.errstate(all="ignore"):
            shadows = self.vectors @ self.a
        self.sound = bool(np.isfinite(shadows).all())
        if self.sound:
            self.order = np.argsort(shadows, axis=0, kind="stable").T.astype(np.int32)
            self.sorted = np.sort(shadows, axis=0).T.copy()

    def nearest(self, query_id: int | None, query: np.ndarray, k: int = NEAREST) -> list[tuple[float, int]]:
        """(distance, place) of the k nearest that collide often enough, nearest first, copies as often as they are there."""
        copies = self.copies
        same = (self.nulls if query_id is None else ~self.nulls & (self.ids == query_id)) & (self.vectors == query).all(axis=1)
        if same.any():  # the query's own row
            copies = copies - same
        with np.errstate(all="ignore"):
            at = query @ self.a
            distance, done = self.collide(query, at, copies, k) if self.sound and np.isfinite(at).all() else (exact(self.vectors, query), copies > 0)
        near = np.flatnonzero(done & (copies > 0))
        near = near[np.lexsort((near, distance[near]))][:k]
        return [(float(distance[i]), int(i)) for i in np.repeat(near, np.minimum(copies[near], k))[:k]]

    def collide(self, query: np.ndarray, at: np.ndarray, copies: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Distances of the vectors verified, and which these are."""
        n = len(self.ids)
        counts, distance, done = np.zeros(n, np.int64), np.full(n, np.inf), copies <= 0
        low = [int(s.searchsorted(x)) for s, x in zip(self.sorted, at)]
        high, radius = list(low), self.start(query)
        while not done.all():
            wider = []
            for j, (shadow, order) in enumerate(zip(self.sorted, self.order)):
                a, b = shadow.searchsorted((at[j] - radius * WINDOW, at[j] + radius * WINDOW)).tolist()
                wider += [order[a : low[j]], order[high[j] : b]]
                low[j], high[j] = min(a, low[j]), max(b, high[j])
            counts += np.bincount(np.concatenate(wider), minlength=n)
            new = np.flatnonzero((counts >= THRESHOLD) & ~done) if np.isfinite(radius) else np.flatnonzero(~done)
            if len(new):
                distance[new] = exact(self.vectors[new], query)
                done[new] = True
            close = copies[(distance <= radius) & (copies > 0)]
            if close.sum() >= k:
                break
            radius *= GROWTH
        return distance, done

    def start(self, query: np.ndarray) -> float:
        """First radius: half the distance to the middle of the block's first vectors, above zero."""
        few = exact(self.vectors[:64], query)
        few = few[(few > 0) & np.isfinite(few)]
        return max(float(np.median(few) / 2), 1e-300) if len(few) else 1e-9


def exact(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Distances, also where squares would leave the range of doubles."""
    difference = vectors - query
    with np.errstate(all="ignore"):
        squares = (difference * difference).sum(axis=1)
        distance = np.sqrt(squares)
        far = ~np.isfinite(squares) | (squares < 1e-290)
        if far.any():
            largest = np.abs(difference[far]).max(axis=1, keepdims=True)
            scaled = np.where(largest > 0, difference[far] / np.where(largest > 0, largest, 1), 0)
            distance[far] = np.where(np.isfinite(largest[:, 0]), largest[:, 0] * np.sqrt((scaled * scaled).sum(axis=1)), np.inf)
    return distance


def usable(rows: DataFrame, ids: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """id, v: the rows that take part."""
    value = F.col(quoted(vector)).cast("array<double>")
    v = F.col("v")
    number = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return (
        rows.select(F.col(quoted(ids)).cast("bigint").alias("id"), value.alias("v"))
        .where(v.isNotNull() & (F.size(v) > 0)).where(number).where(F.exists(v, lambda x: x != 0))
    )


FOUND = "query_id bigint, row bigint, vec_id bigint, score double"


def search(batches, k: int):
    """Of rows sorted by block, its vectors before the queries: the k nearest of each query in each block."""
    key, held, index = None, [], None
    for batch in batches:
        names = batch.schema.names
        columns = [batch.column(names.index(c)).to_numpy(zero_copy_only=False) for c in ("d", "block", "kind", "row")]
        marks = np.stack(columns[:3], axis=1) if batch.num_rows else np.empty((0, 3))
        cuts = [0, *(np.flatnonzero((marks[1:] != marks[:-1]).any(axis=1)) + 1).tolist(), len(marks)]
        for a, b in zip(cuts, cuts[1:]):
            if a == b:
                continue
            size, block, kind = marks[a].tolist()
            if (size, block) != key:
                key, held, index = (size, block), [], None
            part = batch.slice(a, b - a)
            ids = part.column(names.index("id"))
            vectors = part.column(names.index("v")).flatten().to_numpy(zero_copy_only=False).reshape(-1, size)
            nulls, values = ids.is_null().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy(zero_copy_only=False)
            if kind == 0:
                held.append((values, nulls, vectors, part.column(names.index("n")).to_numpy(zero_copy_only=False)))
                continue
            if held:
                index, held = Index(*(np.concatenate(x) for x in zip(*held))), []
            if index is None:
                continue
            out = []
            for i, missing, row, v in zip(values.tolist(), nulls.tolist(), columns[3][a:b].tolist(), vectors):
                own = None if missing else i
                out += [(own, row, None if index.nulls[p] else int(index.ids[p]), s) for s, p in index.nearest(own, v, k)]
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], t) for c, t in enumerate(kinds)], names=["query_id", "row", "vec_id", "score"])


def neighbours(rows: DataFrame, queries: DataFrame, k: int = NEAREST, ids: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows found for each query."""
    base, asked = usable(rows, ids, vector), usable(queries, ids, vector).distinct()
    workers = rows.sparkSession.sparkContext.defaultParallelism
    most = F.least(F.lit(BLOCK), F.ceil(F.lit(ENTRIES) / F.col("d")))
    blocks = F.greatest(F.ceil(F.col("n") / most), F.least(F.lit(workers), F.ceil(F.col("n") / LEAST)))
    # a row for each length of vector
    grid = saved(base.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).select("d", blocks.cast("int").alias("blocks")), "grid", small=True)
    parts = max(1, grid.agg(F.sum("blocks")).first()[0] or 0)
    salt = F.xxhash64("id", "v")
    distinct = base.groupBy("id", "v").agg(F.count("*").alias("n"))
    side = lambda df: df.withColumn("d", F.size("v")).withColumn("row", salt).join(grid, "d")
    vectors = side(distinct).select("d", F.pmod("row", "blocks").cast("int").alias("block"), F.lit(0).alias("kind"), "row", "id", "v", "n")
    wanted = side(asked).select(
        "d", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(1).alias("kind"), "row", "id", "v", F.lit(1).cast("bigint").alias("n")
    )
    placed = vectors.union(wanted).repartitionByRange(parts, "d", "block").sortWithinPartitions("d", "block", "kind")
    found = placed.mapInArrow(lambda batches: search(batches, k), FOUND)
    best = Window.partitionBy("query_id", "row").orderBy("score", F.col("vec_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def ann_report(rows: DataFrame) -> DataFrame:
    """query_id, rank, vec_id, score for the queries whose vec_id is divisible by 100."""
    return neighbours(rows, rows.where(F.col("vec_id") % 100 == 0))
