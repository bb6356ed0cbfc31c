"""Language identification by rank-order profiles of n-grams.

A profile is a list of the most frequent n-grams (one to three characters of words in
lower case, with a space on both sides of a word) in order of frequency. A document goes
to the language whose profile is least out of place: for each of the document's n-grams
the distance between its ranks, or the profile's length where the language lacks it.

Training counts the n-grams of all labelled texts (no sample): a task adds up the counts
of its texts by language, Spark adds those up, and the profiles, `PROFILE` n-grams for each
distinct label, are the only thing that the driver sees.

Cases. A null text, or one without a letter, is `und` with score 0, and so is every text
if no row is labelled. Equal distances go to the smaller label, equal frequencies to the
smaller n-gram. Equal rows get equal results; rows with a null label do not train. Empty
tables give empty results.
"""

from __future__ import annotations

import functools

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetgauge.llm.common import field, map_bodies, quoted, unpacked

PROFILE, UNKNOWN = 400, "und"
#: N-grams that a counting task holds before it adds them up.
HELD = 1 << 20


@functools.cache
def letters() -> np.ndarray:
    """For each code point: its lower case where it is a letter, else a space."""
    table = np.full(0x110000, 32, dtype=np.int64)
    for c in map(chr, range(0x110000)):
        if c.isalpha():
            low = c.lower()
            table[ord(c)] = ord(low) if len(low) == 1 else ord(c)
    return table


def normalised(body: bytes | None) -> np.ndarray:
    """Letters in lower case, one space around each run of them; nothing if there is no letter."""
    points = np.frombuffer((body or b"").decode("utf-8", "replace").encode("utf-32-le"), dtype="<u4")
    chars = letters()[points]
    blank = chars == 32
    chars = chars[~(blank & np.concatenate([[True], blank[:-1]]))] if len(chars) else chars
    if not len(chars) or len(chars) == 1 and chars[0] == 32:
        return np.empty(0, np.int64)
    return np.concatenate([[32], chars, [] if chars[-1] == 32 else [32]]).astype(np.int64)


def grams(chars: np.ndarray) -> np.ndarray:
    """All n-grams as numbers of 21 bits a character; a lone space is none."""
    if not len(chars):
        return chars
    one, two = chars[chars != 32], chars[:-1] << 21 | chars[1:]
    return np.concatenate([one, two, two[:-1] << 21 | chars[2:]])


def ranked(codes: np.ndarray, size: int) -> np.ndarray:
    """The most frequent codes, most frequent first, equal counts by code."""
    values, counts = np.unique(codes, return_counts=True)
    if len(values) > size:
        least = np.partition(counts, len(counts) - size)[len(counts) - size]
        values, counts = values[counts >= least], counts[counts >= least]
    return values[np.argsort(-counts, kind="stable")][:size]


def profiles(labelled: DataFrame, label: str = "lang", text: str = "text", size: int = PROFILE) -> dict[str, list[int]]:
    """Profiles learnt from all rows with a label."""
    kept = labelled.where(F.col(quoted(label)).isNotNull()).select(F.col(quoted(label)).alias("label"), F.col(quoted(text)).cast("binary").alias("body"))

    def count(batches):
        import pyarrow as pa

        totals: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        pending: dict[str, list[np.ndarray]] = {}
        held = 0

        def add():
            for name, parts in pending.items():
                codes, counts = np.unique(np.concatenate(parts), return_counts=True)
                if name in totals:
                    codes, counts = np.concatenate([totals[name][0], codes]), np.concatenate([totals[name][1], counts])
                    codes, place = np.unique(codes, return_inverse=True)
                    counts = np.bincount(place, counts, len(codes)).astype(np.int64)
                totals[name] = codes, counts
            pending.clear()

        for batch in batches:
            for name, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                codes = grams(normalised(body))
                pending.setdefault(name, []).append(codes)
                held += len(codes)
                if held > HELD:
                    add()
                    held = 0
        add()
        for name, (codes, counts) in totals.items():
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(codes), pa.string()), pa.array(codes), pa.array(counts)], names=["label", "gram", "n"])

    counted = kept.mapInArrow(count, "label string, gram bigint, n bigint").groupBy("label", "gram").agg(F.sum("n").alias("n"))
    top = counted.withColumn("place", F.row_number().over(Window.partitionBy("label").orderBy(F.desc("n"), "gram"))).where(F.col("place") <= size)
    learnt: dict[str, list[int]] = {}
    for r in top.orderBy("label", "place").collect():
        learnt.setdefault(r["label"], []).append(r["gram"])
    return learnt


class Model:
    """Profiles as one sorted table of n-grams against languages."""

    def __init__(self, learnt: dict[str, list[int]], size: int = PROFILE):
        self.names, self.size = sorted(learnt), size
        self.codes = np.unique(np.concatenate([np.array(learnt[n], np.int64) for n in self.names] or [np.empty(0, np.int64)]))
        self.places = np.full((len(self.codes) + 1, len(self.names)), -1, dtype=np.int64)
        for k, name in enumerate(self.names):
            self.places[np.searchsorted(self.codes, learnt[name]), k] = np.arange(len(learnt[name]))

    def distances(self, codes: np.ndarray) -> np.ndarray:
        """Out-of-place distance of a document's ranked n-grams to each language."""
        at = np.minimum(np.searchsorted(self.codes, codes), max(0, len(self.codes) - 1))
        at = np.where(self.codes[at] == codes, at, len(self.codes))
        places = self.places[at]
        return np.where(places < 0, self.size, np.abs(places - np.arange(len(codes))[:, None])).sum(axis=0)

    def predict(self, body: bytes | None) -> tuple[str, float]:
        """Label, and one minus the ratio of the best distance to the largest possible."""
        chars = normalised(body)
        if not len(chars) or not self.names:
            return UNKNOWN, 0.0
        codes = ranked(grams(chars), self.size)
        apart = self.distances(codes)
        best = int(np.argmin(apart))
        return self.names[best], float(1 - apart[best] / (self.size * len(codes)))


def predict(docs: DataFrame, learnt: dict[str, list[int]], carry: list[str] | None = None, text: str = "text", size: int = PROFILE) -> DataFrame:
    """`row`, lang_pred and score; nothing but the text decides."""
    model = Model(learnt, size)
    return map_bodies(
        docs, lambda bodies: list(zip(*map(model.predict, bodies))), [field("lang_pred", "string"), field("score", "double")], carry, text
    )


def held_out(ids):
    """The fold that never trains: crc32 of the id's text leaves one when divided by three. A null id trains."""
    return F.coalesce(F.crc32(ids.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def language_report(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score."""
    learnt = profiles(docs.where(~held_out(F.col("doc_id"))))
    rows = predict(docs, learnt, ["doc_id"])
    return unpacked(rows, held_out(F.col("row.doc_id")).alias("held_out"), "lang_pred", "score")
