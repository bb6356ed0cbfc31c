"""Whitening of vectors: leading eigenvectors of their covariance, and every vector projected on them.

1. Sums. One pass adds up each dimension exactly (integers).
2. Covariance. A second pass centres every vector on the exact mean before multiplying;
   each task gives one sum of outer products, and Spark adds these entry by entry.
3. Eigenvectors, on the driver, of a matrix whose size is the dimension squared, whatever
   the rows: Householder reflections make it tridiagonal, Sturm counts bisect the leading
   eigenvalues, inverse iteration gives the vectors; those of eigenvalues that lie close
   together are made orthogonal to each other in each step; the reflections lead back.
4. Projection. Mean and components (the dimension times `COMPONENTS` numbers) go to the tasks, which
   project every vector. Before that, a third pass takes the covariance of the projected
   vectors, which has to be the identity.

An entry c becomes the whole number floor(1024 c) + 100000, so that sums and deviations
are exact. All rows that take part are the fit list.

Cases. Vectors that are null, empty or hold null, NaN or infinite entries take no part; nor
do those with an entry of 2^52 or more either way, whose whole number is no long, nor those
of another length than the most frequent one (of two, the longer).
Repeated rows count each time and give their rows each time. Ids may be null. Equal
eigenvalues share a space, any orthonormal vectors of which are components. A
component without variance (rank below `COMPONENTS`, or one row) has whitened 0 and
explained 0, and is left out of the identity check. With fewer dimensions there are fewer
components. A deviation beyond the range of long is null. Empty tables give empty results.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetgauge.llm.common import field, quoted

COMPONENTS, SCALE, SHIFT, BOUND = 8, 1024, 100_000, float(1 << 52)
#: Entries that one step of a task multiplies at once, so that dimension and batch bound its memory.
STEP = 1 << 20
EPS = np.finfo(float).eps


def taking_part(rows: DataFrame, ids: str = "vec_id", vector: str = "embedding") -> tuple[DataFrame, int]:
    """id, v: the rows of the fit list, with entries as doubles; and their length (0: there are none)."""
    v = F.col("v")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(BOUND)))
    sound = rows.select(F.col(quoted(ids)).alias("id"), F.col(quoted(vector)).cast("array<double>").alias("v")).where(
        v.isNotNull() & (F.size(v) > 0) & fine
    )
    lengths = sound.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    size = lengths["d"] if lengths else 0
    return sound.where(F.size("v") == F.lit(size)), size


def blocks(batch: pa.RecordBatch, size: int):
    """The vectors of a batch as whole numbers, in blocks of bounded size: (first row, matrix)."""
    column = batch.column(batch.schema.get_field_index("v"))
    flat = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, size)
    step = max(1, STEP // size)
    for k in range(0, len(flat), step):
        yield k, np.floor(flat[k : k + step] * SCALE).astype(np.int64) + SHIFT


def sums(vectors: DataFrame, size: int) -> tuple[int, list[int]]:
    """Number of vectors and the exact sums of their entries."""

    def add(batches):
        total, n = np.zeros(size, object), 0
        for batch in batches:
            for _, x in blocks(batch, size):
                high = (x >> 26).sum(axis=0).astype(object)  # in two parts, so that no sum leaves 64 bits
                total, n = total + (high << 26) + (x & (1 << 26) - 1).sum(axis=0), n + len(x)
        yield pa.RecordBatch.from_arrays(
            [pa.array([-1, *range(size)], pa.int32()), pa.array([str(n), *map(str, total)], pa.string())], names=["i", "s"]
        )

    added = vectors.select("v").mapInArrow(add, "i int, s string").groupBy("i").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    found = {r["i"]: int(r["s"]) for r in added.collect()}  # a row for each dimension
    return found[-1], [found[k] for k in range(size)]


def centred_products(rows: DataFrame, size: int, values) -> tuple[int, np.ndarray, np.ndarray]:
    """Count, sum and sum of outer products of what `values` makes of a batch (matrices of `size` columns)."""
    upper = np.triu_indices(size)

    def add(batches):
        n, total, products = 0, np.zeros(size), np.zeros((size, size))
        for batch in batches:
            for x in values(batch):
                n, total, products = n + len(x), total + x.sum(axis=0), products + x.T @ x
        if n:
            entries = np.concatenate([[float(n)], total, products[upper]])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(entries)), pa.int32()), pa.array(entries)], names=["i", "s"])

    added = rows.mapInArrow(add, "i int, s double").groupBy("i").agg(F.sum("s").alias("s"))
    got = np.zeros(1 + size + len(upper[0]))
    for r in added.collect():  # one row for each pair of dimensions
        got[r["i"]] = r["s"]
    products = np.zeros((size, size))
    products[upper] = got[1 + size :]
    return int(got[0]), got[1 : 1 + size], products + np.triu(products, 1).T


def covariance(vectors: DataFrame, n: int, mean: np.ndarray) -> np.ndarray:
    """Covariance (divisor n) of vectors centred on their mean; what the mean's rounding leaves is taken off."""
    size = len(mean)
    _, rest, products = centred_products(
        vectors.select("v"), size, lambda batch: (x - mean for _, x in blocks(batch, size))
    )
    return products / n - np.outer(rest / n, rest / n)


def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Diagonal, off-diagonal and the Householder vectors that make a symmetric matrix tridiagonal."""
    a, size = a.copy(), len(a)
    mirrors = []
    for k in range(size - 2):
        x = a[k + 1 :, k]
        length = np.linalg.norm(x)
        u = x.copy()
        u[0] += np.copysign(length, x[0])
        norm = np.linalg.norm(u)
        u = u / norm if norm > 0 else u
        mirrors.append(u)
        part = a[k + 1 :, k + 1 :]
        p = part @ u
        q = p - (u @ p) * u
        part -= 2 * (np.outer(u, q) + np.outer(q, u))
        a[k + 1 :, k] -= 2 * u * (u @ a[k + 1 :, k])
        a[k, k + 1 :] = a[k + 1 :, k]
    return np.diag(a).copy(), np.diag(a, -1).copy(), mirrors


def back(mirrors: list[np.ndarray], vectors: np.ndarray) -> np.ndarray:
    """Vectors of the tridiagonal matrix as vectors of the original one."""
    out = vectors.copy()
    for k in range(len(mirrors) - 1, -1, -1):
        u = mirrors[k]
        out[k + 1 :] -= 2 * np.outer(u, u @ out[k + 1 :])
    return out


def above(diagonal: np.ndarray, off: np.ndarray, shifts: np.ndarray, least: float) -> np.ndarray:
    """Sturm counts: how many eigenvalues are greater than each shift."""
    q = diagonal[0] - shifts
    count = (q > 0).astype(np.int64)
    for d, e in zip(diagonal[1:], off):
        q = d - shifts - e * e / np.where(np.abs(q) < least, np.where(q < 0, -least, least), q)
        count += q > 0
    return count


def leading(diagonal: np.ndarray, off: np.ndarray, k: int) -> np.ndarray:
    """The k greatest eigenvalues of a tridiagonal matrix, by bisection on Sturm counts, greatest first."""
    radius = np.abs(np.concatenate([[0], off])) + np.abs(np.concatenate([off, [0]]))
    scale = max(np.max(np.abs(diagonal) + radius), np.finfo(float).tiny)
    low, high = np.full(k, np.min(diagonal - radius) - EPS * scale), np.full(k, np.max(diagonal + radius) + EPS * scale)
    least = max(EPS * EPS * scale, np.finfo(float).tiny)
    rank = np.arange(1, k + 1)
    for _ in range(1100):
        middle = low + (high - low) / 2
        if np.all((middle <= low) | (middle >= high)):
            break
        enough = above(diagonal, off, middle, least) >= rank
        low, high = np.where(enough, middle, low), np.where(enough, high, middle)
    return low + (high - low) / 2


def solve(diagonal: np.ndarray, off: np.ndarray, shift: float, right: np.ndarray, least: float) -> np.ndarray:
    """x of (T - shift) x = right, by elimination with row exchanges; zero pivots become `least`."""
    n = len(diagonal)
    d, u, w, x = (diagonal - shift).tolist(), [*off.tolist(), 0.0], [0.0] * n, right.tolist()
    for i in range(n - 1):
        low = off[i]
        if abs(d[i]) >= abs(low):
            d[i] = d[i] if abs(d[i]) > least else least
            f = low / d[i]
            d[i + 1] -= f * u[i]
            x[i + 1] -= f * x[i]
        else:  # the next row goes up
            f = d[i] / low
            d[i], d[i + 1], u[i] = low, u[i] - f * d[i + 1], d[i + 1]
            w[i], u[i + 1] = u[i + 1], -f * u[i + 1]
            x[i], x[i + 1] = x[i + 1], x[i] - f * x[i + 1]
    for i in range(n - 1, -1, -1):
        pivot = d[i] if abs(d[i]) > least else least
        x[i] = (x[i] - (u[i] * x[i + 1] if i + 1 < n else 0.0) - (w[i] * x[i + 2] if i + 2 < n else 0.0)) / pivot
    return np.array(x)


def eigenvectors(diagonal: np.ndarray, off: np.ndarray, values: np.ndarray, close: float = 1e-3, steps: int = 6) -> np.ndarray:
    """Unit vectors (as columns) of the eigenvalues, by inverse iteration.

    Within a cluster, where neighbours differ by less than `close` of the norm, each vector
    is kept orthogonal to those before it in every step, and equal shifts are set apart.
    """
    n = len(diagonal)
    norm = max(np.max(np.abs(diagonal)), np.max(np.abs(off), initial=0.0), np.finfo(float).tiny)
    out, cluster, shift = np.zeros((n, len(values))), 0, 0.0
    chance = np.random.default_rng(7)
    for k, value in enumerate(values):
        cluster = cluster if k and values[k - 1] - value < close * norm else k
        apart = 4 * EPS * norm
        shift = min(value, shift - apart) if k > cluster else value
        x = chance.uniform(-1, 1, n)
        for _ in range(steps):
            for _ in range(2):  # twice, against what the first rounding leaves
                x -= out[:, cluster:k] @ (out[:, cluster:k].T @ x)
            x /= np.linalg.norm(x)
            x = solve(diagonal, off, shift, x, EPS * norm)
            x /= np.max(np.abs(x))
        for _ in range(2):
            x -= out[:, cluster:k] @ (out[:, cluster:k].T @ x)
        out[:, k] = x / np.linalg.norm(x)
    return out


def principal(matrix: np.ndarray, k: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray]:
    """The k greatest eigenvalues, falling, and their unit eigenvectors as columns, the greatest entry of each above zero."""
    k, scale = min(k, len(matrix)), float(np.max(np.abs(matrix)))
    if scale == 0:
        return np.zeros(k), np.eye(len(matrix), k)
    diagonal, off, mirrors = tridiagonal(matrix / scale)
    values = leading(diagonal, off, k)
    vectors = back(mirrors, eigenvectors(diagonal, off, values))
    vectors *= np.sign(vectors[np.argmax(np.abs(vectors), axis=0), np.arange(k)])
    return values * scale, vectors


def whitened(rows: DataFrame, ids: str = "vec_id", vector: str = "embedding", k: int = COMPONENTS) -> DataFrame:
    """id, component, n, deviation, whitened, explained, identity_error, a row for each vector and component."""
    vectors, size = taking_part(rows, ids, vector)
    kinds = {"component": "int", "n": "bigint", "deviation": "bigint", "whitened": "double", "explained": "double", "identity_error": "double"}
    schema = T.StructType([vectors.schema["id"], *(field(name, kind) for name, kind in kinds.items())])
    if not size:
        return rows.sparkSession.createDataFrame([], schema)
    n, total = sums(vectors, size)
    mean = np.array([s / n for s in total])
    matrix = covariance(vectors, n, mean)
    values, components = principal(matrix, k)
    trace = float(np.trace(matrix))
    sound = values > max(size * EPS * 16 * float(np.max(np.abs(matrix))), 0.0)
    explained = np.where(sound, values, 0.0) / (trace or 1.0)
    scaled = np.where(sound, components / np.sqrt(np.where(sound, values, 1.0)), 0.0)  # dimension times k numbers

    def project(batch):
        return ((x - mean) @ scaled for _, x in blocks(batch, size))

    count, rest, products = centred_products(vectors.select("v"), len(values), project)
    identity = products / count - np.outer(rest / count, rest / count)
    apart = np.abs(identity - np.eye(len(values)))[np.ix_(sound, sound)]
    error = float(np.max(apart, initial=0.0))
    each, widest = len(values), max(map(abs, total))

    def deviations(x: np.ndarray) -> list[int | None]:
        reach = float(n) * float(np.max(np.abs(x), initial=0)) + float(widest)
        if reach * reach * size < 2.0**62:
            apart = n * x - np.array(total, np.int64)
            return (apart * apart).sum(axis=1).tolist()
        apart = n * x.astype(object) - np.array(total, object)
        exact = (apart * apart).sum(axis=1)
        return [v if v < 1 << 63 else None for v in exact]

    def emit(batches):
        for batch in batches:
            for first, x in blocks(batch, size):
                rows_in = np.repeat(np.arange(first, first + len(x)), each)
                made = (x - mean) @ scaled
                deviation = pa.array(deviations(x), pa.int64())
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).take(pa.array(rows_in)), pa.array(np.tile(np.arange(1, each + 1, dtype=np.int32), len(x))),
                    pa.array(np.full(len(rows_in), n)), deviation.take(pa.array(rows_in - first)), pa.array(made.ravel()),
                    pa.array(np.tile(explained, len(x))), pa.array(np.full(len(rows_in), error)),
                ], names=schema.names)

    return vectors.select("id", "v").mapInArrow(emit, schema)


def whitening_report(rows: DataFrame) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error."""
    return whitened(rows).withColumnRenamed("id", "vec_id")
