"""Best-fit packing of token sequences by residual vectors.

Every document becomes ids and an end id; only what is longer than a sequence is cut, into
full pieces and one shorter piece in front. A sequence has three capacities: tokens,
documents and attention cost (the sum of squared lengths). A piece goes, longest first, to
the open sequence that fits it under every constraint and that the rule prefers: the
largest weighted dot-product of piece and residual (`dot`), or the smallest weighted norm
of the residual that would be left (`norm`, the default, which is best-fit when tokens
weigh most).

Each capacity has two sizes. The preferred ones (`DOCUMENTS` and `ATTENTION`) keep the
sequences alike in documents and attention cost: a sequence that a piece would take beyond one of
them is out as long as another one fits. The limits (as many documents as tokens, the
cost of one document that fills the sequence) are never passed. A sequence is opened only
where the limits leave none, so that the preferred capacities cost no sequences.

Pieces are dealt by a hash of document and piece into groups of about `GROUP`, packed
apart: a group leaves at most a few sequences underfull, and the number of groups grows
with the input. A piece that fills a sequence alone takes one without a search. Results
depend on the rows only, so that a task that runs again gives the same numbers.

Cases. A null or empty text is the end id alone. Equal rows are packed apart, like any
others; rows with equal (doc_id, piece) are told apart by their place in a fixed order.
Empty tables give empty results.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetgauge.llm.bytelevel import encoder
from fleetgauge.llm.common import field, map_bodies, saved, structs, unpacked

SEQUENCE, END, GROUP = 2048, 0, 4096
#: Preferred capacities: documents of a sequence, and attention cost as a share of a full document's.
DOCUMENTS, ATTENTION = 16, 0.75


def cut(length: int, size: int = SEQUENCE) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document: full ones, and a shorter one in front."""
    first = length % size
    starts = [*([0] if first else []), *range(first, length, size)]
    return [(s, (starts[k + 1] if k + 1 < len(starts) else length) - s) for k, s in enumerate(starts)]


PIECES = structs(piece="int", start="bigint", length="bigint", ids_crc32="bigint")


def tokenized(docs: DataFrame, tokenizer: str, carry: list[str] | None = None, text: str = "text", ids: bool = False, size: int = SEQUENCE) -> DataFrame:
    """`row`, `pieces` (piece, start, length, ids_crc32) and, if asked for, the `ids` of each document with its end id."""

    def work(bodies):
        encode = encoder(tokenizer).encode_to_numpy
        pieces, all_ids = [], []
        for body in bodies:
            text = (body or b"").decode("utf-8", "replace")
            own = np.append(encode(text, allowed_special="all"), [END]).astype("<u4")
            pieces.append([
                {"piece": k, "start": s, "length": n, "ids_crc32": zlib.crc32(own[s : s + n])} for k, (s, n) in enumerate(cut(len(own), size))
            ])
            if ids:
                all_ids.append(own.astype(np.int32))
        return [pieces, all_ids] if ids else [pieces]

    fields = [field("pieces", PIECES)] + [field("ids", T.ArrayType(T.IntegerType()))] * ids
    return map_bodies(docs, work, fields, carry, text)


def best_fit(
    lengths: np.ndarray,
    size: int = SEQUENCE,
    documents: int = SEQUENCE,
    attention: float | None = None,
    weights: tuple[float, float, float] = (1.0, 0.01, 0.05),
    rule: str = "norm",
    preferred_documents: int = DOCUMENTS,
    preferred_attention: float = ATTENTION,
) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of each piece; `lengths` come longest first."""
    capacity = np.array([size, documents, attention or float(size) ** 2])
    scale = np.array(weights) / capacity**2
    beyond = np.maximum(capacity - np.array([size, preferred_documents, preferred_attention * size**2]), 0)
    sequence, offset = np.empty(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    left = np.empty((256, 3))
    open_ids, opened = np.empty(256, np.int64), 0
    made, least = 0, lengths.min(initial=size)
    for k, n in enumerate(lengths.tolist()):
        need = np.array([n, 1.0, float(n) ** 2])
        best = -1
        if opened and n < size:
            rest = left[:opened] - need
            fits = (rest >= 0).all(axis=1)
            preferred = fits & (rest >= beyond).all(axis=1)
            if preferred.any():
                fits = preferred
            if fits.any():
                score = (rest * rest) @ scale if rule == "norm" else -((left[:opened] * need) @ scale)
                best = int(np.argmin(np.where(fits, score, np.inf)))
        if best < 0:
            if (need > capacity).any():
                raise ValueError(f"a piece of {n} tokens fits no sequence")
            if opened == len(left):
                left, open_ids = np.concatenate([left, left]), np.concatenate([open_ids, open_ids])
            best = opened
            left[best], open_ids[best] = capacity, made
            made, opened = made + 1, opened + 1
        sequence[k], offset[k] = open_ids[best], size - left[best, 0]
        left[best] -= need
        if left[best, 0] < least or left[best, 1] < 1:  # no piece fits any more
            opened -= 1
            left[best], open_ids[best] = left[opened], open_ids[opened]
    return sequence, offset


def pack(pieces: DataFrame, group: int = GROUP, **capacities) -> DataFrame:
    """Adds `sequence_id` and `offset` to rows of `row`, piece, start, length, ids_crc32."""
    groups = max(1, -(-pieces.count() // group))
    # rows that repeat another whole are numbered, so that they part as any others
    numbered = pieces.groupBy(*pieces.columns).agg(F.count("*").alias("n")).select(*pieces.columns, F.explode(F.sequence(F.lit(1).cast("bigint"), "n")).alias("copy"))
    salted = numbered.withColumn("salt", F.pmod(F.xxhash64(F.col("row"), "piece", "ids_crc32", "copy"), F.lit(groups))).drop("copy")
    schema = T.StructType([f for f in salted.schema if f.name != "salt"] + [field("sequence_id", "bigint"), field("offset", "bigint")])

    def fill(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        order = rows.assign(_r=rows["row"].map(repr)).sort_values(["length", "_r", "piece", "start"], ascending=[False, True, True, True], kind="stable")
        rows = order.drop(columns=["_r", "salt"])
        sequence, offset = best_fit(rows["length"].to_numpy(), **capacities)
        return rows.assign(sequence_id=(int(key[0]) << 32) + sequence, offset=offset)

    return salted.groupBy("salt").applyInPandas(fill, schema)


def packed_documents(docs: DataFrame, tokenizer: str, carry: list[str] | None = None, text: str = "text") -> DataFrame:
    """`row`, piece, start, length, ids_crc32, sequence_id, offset for every piece of every document."""
    exploded = tokenized(docs, tokenizer, carry, text).select("row", F.explode("pieces").alias("p")).select("row", "p.*")
    return pack(saved(exploded, "pieces"))


def packing_report(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return unpacked(
        packed_documents(docs, tokenizer, ["doc_id"]), "piece", "start", "length", "ids_crc32", "sequence_id", "offset"
    )
