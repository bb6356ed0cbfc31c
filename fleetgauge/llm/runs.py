"""Periodic runs of words, found online along the diagonals of a text against itself.

The diagonal of lag q counts how many words in a row equal the word q places before. A
stretch of period q and length l is a diagonal of l - q matches. A run is a stretch that no
neighbouring word extends and that is at least `LEAST` words and `POWER` periods long.

For each word its earlier occurrences increment the match length of the lags they stand
at; a lag that a word does not increment has ended, and emits its run there and then if it
is long enough. Counting every earlier occurrence of every word would be quadratic, so the
diagonals are sparse: an occurrence counts only where the words before it match as well.

For lags from b to 3b/2 that context is 3b words (five and six words for lags 1 and 2). It
is no longer than the matches of any run of such a lag, and at least two periods long. Of
a context of two periods inside a run, the nearest earlier occurrence stands exactly one
smallest period back: a nearer one, at p < q, would give the context the periods p and q,
so that their common divisor (Fine and Wilf) would be a smaller period of the whole run. So
one earlier occurrence a word and level says all, lags whose stretch has a smaller period
never become active, and the work is the text's length times its logarithm, whatever the
text repeats. Contexts are named by sorting pairs of shorter contexts' names (exact, not
hashed); a word whose context occurs once leaves the levels above.

Documents are rows apart: no shuffle, a task holds one batch of texts. Cases. Null, empty
and white-space texts have no words and no runs. Repeated rows give equal rows. Of runs of
one length the first is the longest one, then that of the smaller period. Empty tables
give empty results. Columns that share a name with a result travel in a struct.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetgauge.llm.common import columns, field, quoted, to_arrow, unpacked

LEAST, POWER = 6, 4


def levels(n: int):
    """(smallest lag, largest lag, words of context) of each level, up to the longest lag that n words allow."""
    yield from ((1, 1, 5), (2, 2, 6))
    b = 3
    while POWER * b <= n:
        yield b, b * 3 // 2, 3 * b
        b = b * 3 // 2 + 1


def ranked(keys: np.ndarray, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Names (from 1, by place; 0 where the key occurs once) and the distance to the key's occurrence before (0: none)."""
    names, lags = np.zeros(n, np.int64), np.zeros(n, np.int64)
    order = np.argsort(keys, kind="stable")
    same = keys[order[1:]] == keys[order[:-1]]
    again = np.flatnonzero(same)
    lags[at[order[again + 1]]] = at[order[again + 1]] - at[order[again]]
    held = np.zeros(len(order), bool)
    held[again], held[again + 1] = True, True
    new = np.concatenate([np.ones(1, bool), ~same])
    names[at[order[held]]] = np.cumsum(new)[held]
    return names, lags


def occurrences(words: list[bytes]):
    """For each level, the places whose context stood before at a lag of the level, and those lags."""
    n = len(words)
    number: dict[bytes, int] = {}
    names = np.fromiter((number.setdefault(w, len(number) + 1) for w in words), np.int64, n)
    if len(number) == n:
        return
    size, wide = 1, names
    for low, high, context in levels(n):
        while size < context and n >= context:
            step = min(context - size, size)
            at = step + np.flatnonzero((wide[step:] > 0) & (wide[:-step] > 0))
            if len(at) < 2:
                return
            wide, lags = ranked(wide[at - step] << 32 | wide[at], at, n)
            size += step
        if n < context:
            return
        places = np.flatnonzero((lags >= low) & (lags <= high))
        if len(places):
            yield places.tolist(), lags[places].tolist(), context


def runs(words: list[bytes]) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs, by start, then period."""
    found = []

    def end(lag: int, began: int, last: int, context: int) -> None:
        start = began - context + 1 - lag
        if last - start + 1 >= max(LEAST, POWER * lag):
            found.append((start, last - start + 1, lag))

    for places, lags, context in occurrences(words):
        active, began, before = 0, 0, -2  # the one lag that the last word has incremented
        for at, lag in zip(places, lags):
            if active and (at != before + 1 or lag != active):
                end(active, began, before, context)
                active = 0
            if not active:
                active, began = lag, at
            before = at
        if active:
            end(active, began, before, context)
    return sorted(found, key=lambda run: (run[0], run[2]))


def collapsed(words: list[bytes], found: list[tuple[int, int, int]]) -> list[bytes]:
    """The words without those that any run contains after its first period."""
    if not found:
        return words
    edges = np.zeros(len(words) + 1, np.int64)
    for start, length, period in found:
        edges[start + period] += 1
        edges[start + length] -= 1
    return [words[k] for k in np.flatnonzero(np.cumsum(edges[:-1]) == 0).tolist()]


def with_period(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The words as the report takes them: of every tenth document (by CRC-32 of its id) the end becomes periodic."""
    g, rest = divmod(zlib.crc32(str(doc_id).encode()), 10)
    n = len(words)
    if rest or not n or doc_id is None:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    part = words[a : a + p]
    return words[:a] + (part * -(-(n - a) // p))[: n - a]


RESULT = {
    "n_runs": "bigint", "start": "bigint", "length": "bigint", "period": "bigint",
    "runs_sha256": "string", "collapsed_sha256": "string", "collapsed": "string",
}


def result(body: bytes | None, doc_id: int | None) -> tuple:
    words = with_period((body or b"").split(), doc_id)
    every = runs(words)
    start, length, period = min(every, key=lambda r: (-r[1], r[0], r[2])) if every else (None,) * 3
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in every).encode()
    kept = b" ".join(collapsed(words, every))
    return len(every), start, length, period, hashlib.sha256(lines).hexdigest(), hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "replace")


def found_runs(docs: DataFrame, carry: list[str] | None = None, text: str = "text", ids: str | None = None) -> DataFrame:
    """`row`, n_runs, the longest run (start, length, period), runs_sha256, collapsed_sha256 and collapsed, the text without repeats.

    The lines of runs_sha256 are `start,length,period`. With `ids`, texts are first made
    periodic by this column, see `with_period`.
    """
    own = F.col(quoted(ids)).cast("bigint") if ids else F.lit(None).cast("bigint")
    source = docs.select(F.struct(*columns(docs, carry)).alias("row"), F.col(quoted(text)).cast("binary").alias("body"), own.alias("id"))
    schema = T.StructType([source.schema["row"], *(field(n, k) for n, k in RESULT.items())])
    arrow = [to_arrow(f.dataType) for f in schema.fields[1:]]

    def find(batches):
        for batch in batches:
            rows = [result(body, i) for body, i in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            made = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(arrow)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *made], names=schema.names)

    return source.mapInArrow(find, schema)


def runs_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_runs, the longest run with its exponent in thousandths, digests of all runs and of the collapsed text."""
    rows = found_runs(docs, ["doc_id"], ids="doc_id")
    exponent = F.floor(F.lit(1000) * F.col("length") / F.col("period")).cast("bigint")
    return unpacked(rows, "n_runs", "start", "length", "period", exponent.alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
