"""Line dedup by a deletion-neighbourhood join.

A line is its words (runs between white space), one space apart. It is compared by its
units: words, or characters if it has fewer than `WORDS_EACH` words. The edit bound
follows the shorter line's length, one edit for each `WORDS_EACH` words or `CHARS_EACH`
characters, and is `edits` at most (one by default, up to three); where it is zero, only
equal lines count. A line is dropped if an earlier one, in the order of (doc_id, text
hash, line number), is of the same kind of unit and within the bound: so many units put
in, left out or replaced. The comparison is with every earlier line, dropped ones too.

Lines within the bound share a variant: what is left of a line without as many of its
units. Replaced units leave equal variants with equal gaps, so a group of equal
(variant, gaps) is as close to its earliest member as the gaps say, and a link to that
member is enough. Lines with other gaps meet the earliest of each group of their variant.
No pairs within a group are made. Variants are keyed by a 64-bit polynomial hash over unit
hashes, which gives all variants of a line in one pass; candidates are then verified on
the units themselves.

With one edit, variants are only emitted where a partner can be: the edit leaves the first
or the last half of the shorter line as it is, so a line none of whose halves is met in
another line is out, and with a half in common only the places beyond it are tried
(pigeonhole, exact). A key filter carries the remaining lines to the second reading of the
texts; exact joins follow it.

Cases. Null and empty texts have no lines to drop; a null text stays null. White-space
lines stay. Rows that repeat a document whole (id and text) count as one document and get
the same result. A null doc_id comes first. Empty tables give empty results.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetgauge.llm.common import KeyFilter, field, map_bodies, packed, quoted, saved, structs, unpacked, with_text

EDITS, MOST_EDITS, WORDS_EACH, CHARS_EACH = 1, 3, 8, 16
#: Variants that a task holds back.
ROWS_HELD = 100_000
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)

HALF = T.StructType([field("half", "bigint"), field("start", "int"), field("stop", "int")])
LINE = structs(line="binary", no="int", halves=T.ArrayType(HALF))


def signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def line_id(words: list[bytes]) -> bytes:
    return xxhash.xxh3_128_digest(b" ".join(words))


def units(words: list[bytes]) -> list[bytes] | str:
    """What a line is compared by: its words, or its characters if it has few words."""
    return words if len(words) >= WORDS_EACH else b" ".join(words).decode("utf-8", "replace")


def bound(line: list[bytes] | str, edits: int) -> int:
    return min(edits, len(line) // (CHARS_EACH if isinstance(line, str) else WORDS_EACH))


def halves(line: list[bytes] | str) -> list[dict]:
    """Keys of the first and last half of the units, for lines of this length and one shorter as the shorter line.

    With a half in common, an edit is at the places from start to stop.
    """
    n, out = len(line), []
    kind, whole = (b"c", str.encode) if isinstance(line, str) else (b"", b" ".join)
    for k in {n // 2, (n - 1) // 2}:
        for part, start, stop in ((kind + b"<" + whole(line[:k]), k, n), (kind + b">" + whole(line[-k:]), 0, n - k)):
            out.append({"half": signed(xxhash.xxh3_64_intdigest(part, k)), "start": start, "stop": stop})
    return out


def lines_of(body: bytes | None, edits: int = EDITS) -> list[dict]:
    """The lines with a word; halves are for the search of one edit, an open pair of places stands for more."""
    out = []
    for no, text in enumerate((body or b"").split(b"\n")):
        words = text.split()
        if words:
            line = units(words)
            near = [] if not bound(line, edits) else halves(line) if edits == 1 else [{"half": 0, "start": 0, "stop": len(line)}]
            out.append({"line": line_id(words), "no": no, "halves": near})
    return out


def unit_hashes(line: list[bytes] | str) -> np.ndarray:
    if not isinstance(line, str):
        return np.fromiter((xxhash.xxh3_64_intdigest(x) for x in line), np.uint64, len(line))
    points = np.frombuffer(line.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
    mixed = points * np.uint64(0xD6E8FEB86659FD93)
    return (mixed ^ mixed >> np.uint64(29)) * np.uint64(0xCA9B0A7F3F1B5D2D)


def variants(line: list[bytes] | str, edits: int) -> tuple[int, list[tuple[int, ...]], np.ndarray]:
    """Hash of the whole line; then all places of up to so many left out units, and the hash of what is left."""
    w = unit_hashes(line)
    n = len(w)
    powers = np.full(n, BASE, np.uint64)
    powers[0] = 1
    powers = np.cumprod(powers, dtype=np.uint64)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(w * powers, dtype=np.uint64)])
    places, hashes = [], []
    for m in range(1, edits + 1):
        cut = np.arange(n).reshape(-1, 1) if m == 1 else np.array(list(combinations(range(n), m)))
        left, begin = np.zeros(len(cut), np.uint64), np.zeros(len(cut), np.int64)
        for k in range(m + 1):
            end = cut[:, k] if k < m else np.full(len(cut), n)
            left += (sums[end] - sums[begin]) * np.uint64(pow(INVERSE, k, 1 << 64))
            begin = end + 1 if k < m else begin
        places += map(tuple, cut.tolist())
        hashes.append(left.view(np.int64))
    return int(sums[-1:].view(np.int64)[0]), places, np.concatenate(hashes)


def gaps(places: tuple[int, ...]) -> int:
    """Where units are left out, as seen from what is left: one number."""
    code = 0
    for k, at in enumerate(places):
        code = code << 20 | at - k + 1
    return code


def within(a: list[bytes] | str, b: list[bytes] | str, edits: int) -> bool:
    """Whether two lines of one kind of unit are within the bound of the shorter one."""
    if isinstance(a, str) != isinstance(b, str):
        return False
    if len(a) > len(b):
        a, b = b, a
    most = bound(a, edits)
    if len(b) - len(a) > most:
        return False
    k = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    a, b = a[k:], b[k:]
    if most <= 1:
        return not b or most == 1 and a[len(a) + 1 - len(b) :] == b[1:]
    row = [j if j <= most else most + 1 for j in range(len(b) + 1)]
    for i, x in enumerate(a, 1):  # a band of the edit-distance table
        new = [most + 1] * (len(b) + 1)
        new[0] = min(i, most + 1)
        for j in range(max(1, i - most), min(len(b), i + most) + 1):
            new[j] = min(row[j - 1] + (x != b[j - 1]), row[j] + 1, new[j - 1] + 1, most + 1)
        row = new
    return row[-1] <= most


def bodies_of(docs: DataFrame, wanted: KeyFilter, text: str) -> DataFrame:
    """line, body of the lines whose key is wanted, once for each task at least."""

    def emit(batches):
        seen: set[bytes] = set()
        for batch in batches:
            rows = []
            for body in batch.column(0).to_pylist():
                for line in (body or b"").split(b"\n"):
                    words = line.split()
                    if words:
                        key = line_id(words)
                        if key not in seen and xxhash.xxh64_intdigest(key, 42) in wanted:
                            seen.add(key)
                            rows.append((key, b" ".join(words)))
            if len(seen) > 200_000:
                seen.clear()
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.binary()) for k in (0, 1)], names=["line", "body"])

    return docs.select(F.col(quoted(text)).cast("binary")).mapInArrow(emit, "line binary, body binary")


def neighbourhoods(lines: DataFrame, edits: int) -> DataFrame:
    """variant, place (the gaps) and first (place of the line in the corpus), for each variant of each line; place -1 is the line itself.

    `lines` has first, body, head and tail: a single edit is at the places from head on, or before tail.
    """
    out = T.StructType([field("variant", "bigint"), field("place", "bigint"), lines.schema["first"]])

    def emit(batches):
        for batch in batches:
            rows, variant, place = [], [], []
            for k, (body, head, tail) in enumerate(zip(*(batch.column(c).to_pylist() for c in (1, 2, 3)))):
                line = units(body.split(b" "))
                own, cuts, left = variants(line, bound(line, edits))
                tried = [i for i, cut in enumerate(cuts) if len(cut) > 1 or cut[0] >= head or cut[0] < tail]
                rows += [k] * (len(tried) + 1)
                place += [-1, *(gaps(cuts[i]) for i in tried)]
                variant += [own, *left[tried].tolist()]
                if len(rows) > ROWS_HELD:
                    yield made(batch, rows, variant, place)
                    rows, variant, place = [], [], []
            yield made(batch, rows, variant, place)

    def made(batch, rows, variant, place):
        arrays = [pa.array(variant, pa.int64()), pa.array(place, pa.int64()), batch.column(0).take(pa.array(rows, pa.int64()))]
        return pa.RecordBatch.from_arrays(arrays, names=out.names)

    return lines.select("first", "body", "head", "tail").mapInArrow(emit, out)


def candidates(spread: DataFrame, edits: int) -> DataFrame:
    """later, earlier: lines that share a variant, each with the earliest of a group of equal gaps."""
    groups = spread.groupBy("variant", "place").agg(F.min("first").alias("earlier"), F.count("*").alias("n"))
    after = F.col("first") > F.col("earlier")
    same = spread.where("place >= 0").join(groups.where("n > 1 and place >= 0").drop("n"), ["variant", "place"]).where(after)
    others = groups.select("variant", F.col("place").alias("gaps"), "earlier")
    whole, cut = spread.where("place < 0"), spread.where("place >= 0")
    # one edit between lines of other gaps: one of them lacks nothing
    sides = [(cut, others.where("gaps < 0")), (whole, others.where("gaps >= 0"))] if edits == 1 else [(spread, others)]
    found = same.select(F.col("first").alias("later"), "earlier")
    for left, right in sides:
        found = found.union(left.join(right, "variant").where((F.col("place") != F.col("gaps")) & after).select(F.col("first").alias("later"), "earlier"))
    return found.distinct()


def verified(pairs: DataFrame, edits: int) -> DataFrame:
    def check(batches):
        for batch in batches:
            ok = [within(units(a.split(b" ")), units(b.split(b" ")), edits) for a, b in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(ok, pa.bool_()))], names=["line"])

    return pairs.mapInArrow(check, "line binary").distinct()


def near_repeats(distinct: DataFrame, docs: DataFrame, text: str, edits: int = EDITS) -> DataFrame:
    """`line` of the distinct lines (line, first, halves) with an earlier line within the bound."""
    halved = distinct.select("line", F.inline("halves"))
    if edits == 1:
        shared = halved.groupBy("half").agg(F.count("*").alias("n")).where("n > 1").select("half")
        halved = halved.join(shared, "half", "left_semi")
    # the places to try: from the first common first half on, and up to the end before the last common last half
    partners = halved.groupBy("line").agg(
        F.coalesce(F.min(F.when(F.col("start") > 0, F.col("start"))), F.lit(1 << 30)).alias("head"),
        F.coalesce(F.max(F.when(F.col("start") == 0, F.col("stop"))), F.lit(0)).alias("tail"),
    )
    partners = partners.join(distinct.select("line", "first"), "line").withColumn("key", F.xxhash64("line"))
    partners = saved(partners, "partners")
    bodies = bodies_of(docs, KeyFilter(partners, "key"), text).groupBy("line").agg(F.first("body").alias("body"))
    near = saved(bodies.join(partners.drop("key"), "line").withColumn("code", code("first")), "near-lines")
    pairs = candidates(saved(neighbourhoods(near, edits), "variants"), edits)
    at = lambda side: near.select(F.col("code").alias(f"{side}_code"), F.col("first").alias(f"{side}_first"), F.col("body").alias(f"{side}_body"), "line")
    texts = (
        pairs.join(at("later"), (code("later") == F.col("later_code")) & (F.col("later") == F.col("later_first"))).drop("later_code", "later_first")
        .join(at("earlier").drop("line"), (code("earlier") == F.col("earlier_code")) & (F.col("earlier") == F.col("earlier_first")))
    )
    return verified(texts.select("line", "later_body", "earlier_body"), edits)


def code(place: str):
    """A join key of a place in the corpus; places may hold a null id."""
    return F.xxhash64(place)


def repeats(docs: DataFrame, ids: str = "doc_id", text: str = "text", edits: int = EDITS) -> DataFrame:
    """id, text_key, n_lines, removed: for each document the numbers (from 0) of the lines to drop."""
    if not 1 <= edits <= MOST_EDITS:
        raise ValueError(f"the edit bound is from 1 to {MOST_EDITS}, not {edits}")
    source = docs.select(F.col(quoted(ids)).alias("id"), F.xxhash64(quoted(text)).alias("text_key"), F.col(quoted(text)).alias("body"))
    marked = map_bodies(
        source, lambda bodies: [[lines_of(b, edits) for b in bodies], [0 if b is None else b.count(b"\n") + 1 for b in bodies]],
        [field("lines", LINE), field("n_lines", "bigint")], ["id", "text_key"], "body",
    )
    marked = saved(unpacked(marked, "lines", "n_lines"), "marked")
    places = marked.select("id", "text_key", F.explode("lines").alias("l")).select(
        F.struct("id", "text_key", F.col("l.no").alias("no")).alias("place"), "l.line", "l.halves"
    )
    distinct = saved(places.groupBy("line").agg(F.min("place").alias("first"), F.first("halves").alias("halves")), "lines")
    near = saved(near_repeats(distinct, docs, text, edits), "near")
    # a line stays at its first place only, so the places that stay say which go
    stays = distinct.join(near, "line", "left_anti").groupBy(F.col("first.id").alias("_id"), F.col("first.text_key").alias("_key")).agg(
        F.collect_list("first.no").alias("kept")  # of one document
    )
    same = F.col("id").eqNullSafe(F.col("_id")) & (F.col("text_key") == F.col("_key"))
    listed = marked.select("id", "text_key", "n_lines", F.col("lines.no").alias("nos")).join(stays, same, "left")
    removed = F.array_except("nos", F.coalesce("kept", F.array().cast("array<int>")))
    return listed.select("id", "text_key", "n_lines", removed.alias("removed"))


def line_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_removed, removed (the numbers of the lines to drop, from 0, comma-joined)."""
    return repeats(docs).select(
        F.col("id").alias("doc_id"), "n_lines", F.size("removed").cast("bigint").alias("n_removed"),
        F.array_join(F.col("removed").cast("array<string>"), ",").alias("removed"),
    )


def deduplicated(docs: DataFrame, ids: str = "doc_id", text: str = "text", edits: int = EDITS) -> DataFrame:
    """The documents without their repeated lines."""
    drop = repeats(docs, ids, text, edits).where(F.size("removed") > 0).select("id", F.col("text_key").alias("key"), "removed").dropDuplicates(["id", "key"])
    keyed = packed(docs, None, text).select("row", "body", F.col(f"row.{quoted(ids)}").alias("own"), F.xxhash64(F.col("body").cast("string")).alias("own_key"))
    joined = keyed.join(saved(drop, "removed"), F.col("own").eqNullSafe(F.col("id")) & (F.col("own_key") == F.col("key")), "left").select("row", "body", "removed")

    def cut(batches):
        for batch in batches:
            out = []
            for body, gone in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                if gone:
                    gone = set(gone)
                    body = b"\n".join(line for no, line in enumerate(body.split(b"\n")) if no not in gone)
                out.append(body)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary()).cast(pa.string())], names=["row", "kept"])

    schema = T.StructType([joined.schema["row"], field("kept", "string")])
    return with_text(joined.mapInArrow(cut, schema), "kept", text)
