"""Token counts of whole texts; huge texts are encoded in overlapping chunks that are spliced.

A byte-level tokenizer reads a text from left to right: special strings first, then words
by a pattern, then the merges inside each word. What follows a word's beginning depends on
the text from there on alone, and where a word ends depends on two characters after it at
most, or on the longest special string. So

* a word that begins in a chunk at least that far before the chunk's end begins there in
  the whole text too, if the chunk was read from a word's true beginning;
* two chunks that both begin a word at one position give equal tokens from there on.

Chunks of `CHUNK` characters overlap the next by `OVERLAP` and are encoded with offsets,
in tasks of their own, from wherever they begin. The first position in an overlap at which
both neighbours begin a word, and which is far enough from the first one's end, is proven:
the left chunk's tokens count up to it, the right one's from it on. Where an overlap has no
such position (a word longer than it), it is widened to the whole next chunk and the next
overlap, again until all neighbours are spliced. The rounds follow the longest word.

Texts of up to `HUGE` characters are not cut, and need no offsets: their ids come from the
faster of two libraries with equal ids (`bytelevel.py`).

Cases. Null and empty texts have no bytes and no tokens. Copies of a huge text are encoded
once. Repeated rows give equal rows. Empty tables give empty results. The carried columns
travel in a struct, so that names may clash. A tokenizer file for which the above is not
proven (a normalizer, another splitting, special strings that take spaces) is an error.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetgauge.llm.bytelevel import encoder, library
from fleetgauge.llm.common import columns, field, quoted, saved, structs, to_arrow, unpacked

HUGE, CHUNK, OVERLAP, LIMIT = 32_768, 16_384, 512, 512
#: Chunks that a task encodes at once.
SOME = 16


def beginnings(encoding, first: int, until: int) -> list[tuple[int, int]]:
    """(position, tokens before it) of the words of an encoded chunk that begin before `until`; the chunk begins at `first`."""
    out = []
    for k in range(len(encoding)):
        at = first + encoding.token_to_chars(k)[0]
        if at >= until:
            break
        if k == 0 or encoding.token_to_word(k) != encoding.token_to_word(k - 1):
            out.append((at, k))
    return out


def endings(encoding, first: int, since: int, until: int) -> list[tuple[int, int]]:
    """The same of the words that begin from `since` to `until`."""
    out = []
    for k in range(len(encoding) - 1, -1, -1):
        at = first + encoding.token_to_chars(k)[0]
        if at < since:
            break
        if at <= until and (k == 0 or encoding.token_to_word(k) != encoding.token_to_word(k - 1)):
            out.append((at, k))
    return out


PLACES = structs(pos="bigint", before="bigint")
CHUNKS = T.StructType([field("key", "string"), field("start", "bigint"), field("next", "bigint"), field("stop", "bigint"), field("size", "bigint"), field("chunk", "string")])
SPLICES = T.StructType([field("key", "string"), field("start", "bigint"), field("next", "bigint"), field("n", "bigint"), field("head", PLACES), field("tail", PLACES)])


def in_batches(rows, schema: T.StructType, some: int):
    """Record batches of so many rows."""
    held = []
    kinds = [(f.name, to_arrow(f.dataType)) for f in schema]
    for row in rows:
        held.append(row)
        if len(held) == some:
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in held], t) for k, (_, t) in enumerate(kinds)], names=[n for n, _ in kinds])
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in held], t) for k, (_, t) in enumerate(kinds)], names=[n for n, _ in kinds])


def chunks(texts: DataFrame) -> DataFrame:
    """The chunks of key, text, spans (start, next, stop), one row for each; `next` is where the next begins, null for the last."""

    def slices(batches):
        for batch in batches:
            for key, text, spans in zip(*(batch.column(k) for k in range(3))):
                own, name = text.as_py(), key.as_py()
                for s in spans.as_py():
                    yield name, s["start"], s["next"], s["stop"], len(own), own[s["start"] : s["stop"]]

    return texts.select("key", "text", "spans").mapInArrow(lambda batches: in_batches(slices(batches), CHUNKS, SOME), CHUNKS)


def encoded(pieces: DataFrame, path: str, overlap: int) -> DataFrame:
    """key, start, next, n (tokens), head and tail: words that begin in the overlaps with the chunk before and, proven, with the next."""

    def encode(batches):
        tokenizer, far = library(path)

        def each():
            for batch in batches:
                for some in (batch.slice(k, SOME) for k in range(0, batch.num_rows, SOME)):
                    rows = list(zip(*(c.to_pylist() for c in some.columns)))
                    made = tokenizer.encode_batch([r[5] for r in rows], add_special_tokens=False)
                    for (key, start, after, stop, size, _), e in zip(rows, made):
                        certain = stop if stop == size else stop - far
                        head = beginnings(e, start, start + overlap)
                        tail = [] if after is None else endings(e, start, after, certain)
                        yield key, start, after, len(e), *([{"pos": p, "before": n} for p, n in x] for x in (head, tail))

        yield from in_batches(each(), SPLICES, 256)

    return pieces.mapInArrow(encode, SPLICES)


def spliced(parts: DataFrame) -> DataFrame:
    """key, start, next, n, pos, gone: each chunk with the first common beginning with the next (null: none) and the tokens that both count."""
    tails = parts.where("next is not null").select("key", "start", "next", F.explode("tail").alias("t")).select("key", "start", "next", "t.*")
    heads = parts.select("key", F.col("start").alias("next"), F.explode("head").alias("h")).select("key", "next", F.col("h.pos").alias("pos"), F.col("h.before").alias("skipped"))
    first = tails.join(heads, ["key", "next", "pos"]).groupBy("key", "start").agg(F.min(F.struct("pos", "before", "skipped")).alias("m"))
    return parts.select("key", "start", "next", "n").join(first, ["key", "start"], "left").select(
        "key", "start", "next", "n", F.col("m.pos").alias("pos"), (F.col("m.before") - F.col("m.skipped")).alias("own")
    )


def huge_counts(docs: DataFrame, path: str, text: str, chunk: int, overlap: int, huge: int) -> DataFrame:
    """key (SHA-256 of the text), n_tokens of the texts longer than `huge`."""
    if not overlap < chunk <= huge:
        raise ValueError("overlaps have to be shorter than chunks, and chunks no longer than texts that are cut")
    own = F.col(quoted(text))
    texts = docs.where(F.length(own) > huge).select(F.sha2(own, 256).alias("key"), own.alias("text"))
    size = F.length("text").cast("bigint")
    starts = F.sequence(F.lit(0).cast("bigint"), size - 1, F.lit(chunk).cast("bigint"))

    def span(start, after, size):
        return F.struct(start.alias("start"), after.alias("next"), F.least(size, F.coalesce(after, size) + overlap).alias("stop"))

    begun = F.transform(starts, lambda s: span(s, F.when(s + chunk < size, s + chunk), size))
    pieces = chunks(texts.withColumn("spans", begun))
    once = pieces.groupBy("key", "start").agg(F.first(F.struct("next", "stop", "size", "chunk")).alias("c")).select("key", "start", "c.*").select(*CHUNKS.names)
    parts = saved(encoded(once, path, overlap), "chunks")
    while True:
        state = saved(spliced(parts), "spliced")
        open_ = state.where("next is not null and pos is null")
        if open_.isEmpty():
            break
        # what follows an open chunk joins it: the overlap is then all of the next chunk and the next overlap
        gone = open_.select("key", F.col("next").alias("start"))
        stay = parts.select("key", "start").join(gone, ["key", "start"], "left_anti")
        after = F.lead("start").over(Window.partitionBy("key").orderBy("start"))  # chunks of one text
        planned = stay.withColumn("after", after).join(parts, ["key", "start"])
        wider = saved(planned.where(~F.col("after").eqNullSafe(F.col("next"))).select("key", "start", F.col("after").alias("next")), "wider")
        lists = wider.groupBy("key").agg(F.collect_list(F.struct("start", "next")).alias("w"))
        again = texts.join(lists, "key").dropDuplicates(["key"])
        again = again.withColumn("spans", F.transform("w", lambda s: span(s["start"], s["next"], size)))
        kept = planned.where(F.col("after").eqNullSafe(F.col("next"))).select(*SPLICES.names)
        parts = saved(kept.unionByName(encoded(chunks(again), path, overlap)), "chunks")
    return state.groupBy("key").agg(F.sum(F.when(F.col("next").isNull(), F.col("n")).otherwise(F.col("own"))).cast("bigint").alias("n_tokens"))


def token_counts(
    docs: DataFrame, tokenizer: str, carry: list[str] | None = None, text: str = "text",
    chunk: int = CHUNK, overlap: int = OVERLAP, huge: int = HUGE,
) -> DataFrame:
    """`row` (the carried columns), n_bytes and n_tokens of every text."""
    own = F.col(quoted(text))
    is_huge = F.coalesce(F.length(own) > huge, F.lit(False))
    source = docs.select(
        F.struct(*columns(docs, carry)).alias("row"), F.coalesce(F.octet_length(own), F.lit(0)).cast("bigint").alias("n_bytes"),
        F.when(is_huge, F.sha2(own, 256)).alias("key"), F.when(~is_huge, own.cast("binary")).alias("body"),
    )
    schema = T.StructType([*source.schema.fields[:3], field("n_tokens", "bigint")])

    def count(batches):
        ids = encoder(tokenizer).encode_to_numpy
        for batch in batches:
            n = [None if b is None else len(ids(b.decode("utf-8", "replace"), allowed_special="all")) for b in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(n, pa.int64())], names=schema.names)

    counted = saved(source.mapInArrow(count, schema), "counted")
    totals = huge_counts(docs, tokenizer, text, chunk, overlap, huge)
    short = counted.where("key is null").select("row", "n_bytes", F.coalesce("n_tokens", F.lit(0)).cast("bigint").alias("n_tokens"))
    return short.unionByName(counted.where("key is not null").drop("n_tokens").join(totals, "key").select("row", "n_bytes", "n_tokens"))


def tokens_report(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (more than LIMIT tokens)."""
    return unpacked(token_counts(docs, tokenizer, ["doc_id"]), "n_bytes", "n_tokens", (F.col("n_tokens") > LIMIT).alias("over_limit"))
