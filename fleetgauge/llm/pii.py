"""Personal data: exact patterns, and terms that disclose a protected entity.

Patterns find emails, IP addresses, card and phone numbers. Each value found is a
protected entity. The corpus then says how strongly a term reveals it: with lines as
contexts, n distinct lines in all, n(e) with the entity, n(t) with the term and n(e,t)
with both, the disclosure of t about e is

    pointwise mutual information / information content = log(n n(e,t) / (n(e) n(t))) / log(n / n(e))

which is 0 for independence and 1 where the term occurs with the entity only. A term that
stands with an entity in at least `SUPPORT` distinct lines and discloses at least
`GENERALISE` of it is generalised (`<TERM>`) in every text that holds the entity, and
removed from `REMOVE` on. Texts that hold no protected entity are left as they are.

All counts are of distinct lines of all documents, and no line travels with its terms:

* lines with an entity are few, so their (entity, term) pairs come first, from the terms of
  each such line once, whole;
* n is the number of distinct line hashes;
* with n, the threshold turns into a bound for each pair: n(t) <= n(e,t) (n / n(e)) ^ (1 - threshold).
  In one of `SAMPLE` lines by hash, all terms are counted. A term with more lines there alone
  than any of its bounds is out, which proves common words out; what this leaves
  open is counted exactly, as pairs of line and term hashes.

A filter of a size that follows the number of open terms keeps tasks from sending others;
the join that follows is exact.

Cases. A null text is empty: no spans. Repeated rows are the same text and get the same
spans; equal lines count once everywhere, so copies neither disclose nor hide. Ties in
spans are ordered by kind. Empty tables give empty results.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetgauge.llm.common import KeyFilter, field, packed, quoted, saved, structs, to_arrow, unpacked, with_text

SUPPORT, GENERALISE, REMOVE = 3, 0.8, 0.95
#: One of so many lines tells common terms; lines and words that a task remembers, and rows that it holds back.
SAMPLE, LINES_KEPT, WORDS_KEPT, ROWS_HELD = 64, 200_000, 100_000, 100_000

#: The patterns of the four kinds, in the order in which kinds are listed.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
#: A match can only begin where a run of digits does, which keeps long runs linear.
IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
KINDS = ("email", "ip", "card", "phone")

DIGITS = re.compile(r"[^0-9]+")
EDGES = ".,;:!?()[]{}<>\"'|*#$%&"


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches of [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+, sought from each @ outwards: a long run without one costs nothing."""
    found, end = [], 0
    at = text.find("@")
    while at >= 0:
        domain = DOMAIN.match(text, at)
        if domain and at >= end:
            start = at
            while start > end and text[start - 1] in LOCAL:
                start -= 1
            if start < at:
                end = domain.end()
                found.append((start, end))
        at = text.find("@", at + 1)
    return found


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(map(int, reversed(digits))):
        d = 2 * d if k % 2 else d
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 4 and int(part or "0") <= 255


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the four kinds, by start, then kind as listed."""
    found = [(a, b, 0) for a, b in emails(text)]
    if text.count(".") > 2:
        found += [(m.start(), m.end(), 1) for m in IP.finditer(text) if all(map(small, m.group().split(".")))]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 14 and 14 <= len(d := DIGITS.sub("", m.group())) <= 19 and luhn(d):
            found.append((m.start(), m.end(), 2))
    if "+" in text:
        found += [(m.start(), m.end(), 3) for m in PHONE.finditer(text) if 10 <= len(DIGITS.sub("", m.group())) <= 15]
    return [(a, b, KINDS[k]) for a, b, k in sorted(found, key=lambda x: (x[0], x[2]))]


def entity(text: str, span: tuple[int, int, str]) -> str:
    """What a span names, without its writing: addresses in lower case, numbers as digits."""
    value = text[span[0] : span[1]]
    return f"{span[2]}:{value.lower() if span[2] in ('email', 'ip') else DIGITS.sub('', value)}"


def terms(line: str) -> set[str]:
    """Distinct words of a line in lower case, without punctuation at their ends."""
    return {w.strip(EDGES) for w in line.lower().split()} - {""}


def entity_contexts(body: bytes | None) -> list[tuple[int, str | None, list[str]]]:
    """(line hash, entity, terms that only its own spans hold) for every entity of a line, and (line hash, None, all terms) once for the line."""
    text = (body or b"").decode("utf-8", "replace")
    by_line: dict[tuple[int, int], list] = {}
    end = -1
    for span in base_spans(text):
        if span[0] > end:
            start = text.rfind("\n", 0, span[0]) + 1
            end = text.find("\n", span[0])
            end = len(text) if end < 0 else end
        by_line.setdefault((start, end), []).append(span)
    out = []
    for (start, end), spans in by_line.items():
        digest = xxhash.xxh64_intdigest(text[start:end].encode(), 7) >> 1
        words = [(m.start(), m.end(), m.group().lower().strip(EDGES)) for m in re.compile(r"\S+").finditer(text, start, end)]
        ends, counts = [w[1] for w in words], Counter(w[2] for w in words)
        held: dict[str, set[int]] = {}
        for span in spans:
            k, at = bisect_right(ends, span[0]), held.setdefault(entity(text, span), set())
            while k < len(words) and words[k][0] < span[1]:
                at.add(k)
                k += 1
        for name, at in held.items():
            inside = Counter(words[k][2] for k in at)
            out.append((digest, name, sorted(t for t, n in inside.items() if n == counts[t])))
        out.append((digest, None, sorted(set(counts) - {""})))
    return out


def line_terms(docs: DataFrame, wanted: KeyFilter | None, text: str = "text") -> DataFrame:
    """line, term: hashes of lines and of their wanted terms, a line once for each task at least.

    Without a filter, the term is null and stands for the line itself, and one of `SAMPLE`
    lines has all of its terms as well.
    """

    def find(batches):
        seen: set[int] = set()
        known: dict[str, int | None] = {}

        def key(word: str) -> int | None:
            term = word.strip(EDGES)
            h = xxhash.xxh64_intdigest(term.encode(), 42) if term else None
            known[word] = h = None if h is None or wanted is not None and h not in wanted else signed(h)
            return h

        def made(lines: list[int], terms: list[int | None]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(lines, pa.int64()), pa.array(terms, pa.int64())], names=["line", "term"])

        lines: list[int] = []
        terms: list[int | None] = []
        for batch in batches:
            for body in batch.column(0):
                for line in (body.as_py() or b"").decode("utf-8", "replace").split("\n"):
                    digest = xxhash.xxh64_intdigest(line.encode(), 7) >> 1
                    if digest in seen:
                        continue
                    seen.add(digest)
                    if wanted is None:
                        lines.append(digest)
                        terms.append(None)
                    if wanted is not None or digest % SAMPLE == 0:
                        own = {known[w] if w in known else key(w) for w in set(line.lower().split())} - {None}
                        lines += [digest] * len(own)
                        terms += own
                if len(lines) > ROWS_HELD:
                    yield made(lines, terms)
                    lines, terms = [], []
                if len(seen) > LINES_KEPT:
                    seen.clear()
                if len(known) > WORDS_KEPT:
                    known.clear()
        yield made(lines, terms)

    return docs.select(F.col(quoted(text)).cast("binary").alias("body")).mapInArrow(find, "line bigint, term bigint")


def signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def term_counts(docs: DataFrame, joint: DataFrame, text: str = "text") -> tuple[int, DataFrame]:
    """n, the number of distinct lines; and those pairs of `joint` that may disclose, with n_t, the lines of their terms."""
    sample = saved(line_terms(docs, None, text), "line-hashes")
    n = sample.where("term is null").select("line").distinct().count()
    often = sample.where("term is not null").groupBy("term").agg(F.countDistinct("line").alias("least"))
    most = F.col("n_et") * F.pow(F.lit(float(n)) / F.col("n_e"), F.lit(1 - GENERALISE)) * (1 + 1e-9)
    keyed = joint.withColumn("key", F.xxhash64("term"))
    may = keyed.join(often.withColumnRenamed("term", "key"), "key", "left").where(F.coalesce("least", F.lit(0)) <= most).drop("least")
    may = saved(may, "open-pairs")
    pairs = line_terms(docs, KeyFilter(may, "key"), text).distinct()
    counted = pairs.groupBy(F.col("term").alias("key")).agg(F.count("*").alias("n_t"))
    return n, may.join(counted, "key").drop("key")


def entity_lines(docs: DataFrame, text: str = "text") -> DataFrame:
    """text_key, line, entity, terms of every text: see `entity_contexts`."""

    def find(batches):
        for batch in batches:
            keys, bodies = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            rows = [(key, *x) for key, body in zip(keys, bodies) for x in entity_contexts(body)]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(LINES.types)], schema=LINES)

    keyed = docs.select(F.xxhash64(quoted(text)).alias("text_key"), F.col(quoted(text)).cast("binary").alias("body"))
    return keyed.mapInArrow(find, "text_key bigint, line bigint, entity string, terms array<string>")


LINES = pa.schema([("text_key", pa.int64()), ("line", pa.int64()), ("entity", pa.string()), ("terms", pa.list_(pa.string()))])


def disclosures(docs: DataFrame, text: str = "text", support: int = SUPPORT) -> DataFrame:
    """text_key, term, disclosure: for each text (by its hash) the terms that reveal an entity it holds."""
    lines = saved(entity_lines(docs, text), "entity-lines")
    held, whole = lines.where("entity is not null"), lines.where("entity is null")
    known = held.groupBy("entity").agg(F.countDistinct("line").alias("n_e")).where(F.col("n_e") >= support)
    own = held.join(known, "entity").groupBy("entity", "n_e", "line").agg(F.first("terms").alias("own"))
    contexts = whole.join(own.select("line").distinct(), "line", "left_semi").groupBy("line").agg(F.first("terms").alias("terms"))
    joint = saved(
        own.join(contexts, "line").select("entity", "n_e", F.explode(F.array_except("terms", "own")).alias("term"))
        .groupBy("entity", "n_e", "term").agg(F.count("*").alias("n_et")).where(F.col("n_et") >= support),
        "joint",
    )
    n, counted = term_counts(docs, joint, text)
    n_all = F.lit(float(n))
    information = F.log(n_all / F.col("n_e"))
    mutual = F.log(n_all * F.col("n_et") / F.col("n_e") / F.col("n_t"))
    revealing = (
        counted.withColumn("disclosure", F.when(information > 0, mutual / information).otherwise(0.0))
        .where(F.col("disclosure") >= GENERALISE).select("entity", "term", "disclosure")
    )
    return (
        held.select("text_key", "entity").distinct().join(revealing, "entity")
        .groupBy("text_key", "term").agg(F.max("disclosure").alias("disclosure"))
    )


SPANS = structs(start="bigint", end="bigint", kind="string", disclosure="double")


def all_spans(text: str, flagged: dict[str, float]) -> list[tuple[int, int, str, float | None]]:
    """The base spans, and the places of the flagged terms outside them."""
    base = base_spans(text)
    if not flagged:
        return [(*s, None) for s in base]
    found, k = [(*s, None) for s in base], 0
    for m in re.finditer(r"\S+", text):
        word = m.group()
        a = m.start() + len(word) - len(word.lstrip(EDGES))
        b = m.end() - (len(word) - len(word.rstrip(EDGES)))
        while k < len(base) and base[k][1] <= m.start():
            k += 1
        j, clear = k, True
        while clear and j < len(base) and base[j][0] < b:
            clear = base[j][1] <= a
            j += 1
        if a < b and clear and (d := flagged.get(text[a:b].lower())) is not None:
            found.append((a, b, "term", d))
    order = {k: i for i, k in enumerate((*KINDS, "term"))}
    return sorted(found, key=lambda s: (s[0], order[s[2]]))


def sanitise(text: str, spans) -> str:
    """The text with each span replaced by its kind, and terms of high disclosure taken out."""
    out, at = [], 0
    for start, end, kind, disclosure in spans:
        if start >= at:
            out.append(text[at:start])
            out.append("" if kind == "term" and disclosure >= REMOVE else f"<{kind.upper()}>")
        elif end > at:
            out.append("")
        at = max(at, end)
    return "".join([*out, text[at:]])


def protect(docs: DataFrame, carry: list[str] | None = None, text: str = "text", sanitised: bool = True) -> DataFrame:
    """`row`, the kinds' counts, `spans` (start, end, kind, disclosure) and, if asked for, the `sanitised` text."""
    flagged = F.collect_list(F.struct("term", "disclosure")).alias("flagged")  # of one text: no more than its words
    revealing = saved(disclosures(docs, text).groupBy(F.col("text_key").alias("key")).agg(flagged), "revealing")
    keyed = packed(docs, carry, text).withColumn("key", F.xxhash64(F.col("body").cast("string")))
    joined = keyed.join(revealing, "key", "left").select("row", "body", "flagged")
    fields = [*(field(f"n_{k}", "bigint") for k in KINDS), field("spans", SPANS), *[field("sanitised", "string")] * sanitised]
    kinds = [to_arrow(f.dataType) for f in fields]
    schema = T.StructType([joined.schema["row"], *fields])

    def find(batches):
        for batch in batches:
            rows = []
            for body, found in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                plain = (body or b"").decode("utf-8", "replace")
                spans = all_spans(plain, {x["term"]: x["disclosure"] for x in found or ()})
                counts = Counter(s[2] for s in spans)
                row = [*(counts[k] for k in KINDS), [dict(zip(("start", "end", "kind", "disclosure"), s)) for s in spans]]
                rows.append([*row, *[None if body is None else sanitise(plain, spans)] * sanitised])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds))], names=schema.names
            )

    return joined.mapInArrow(find, schema)


def pii_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, all spans as kind:start:end, and their number."""
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("spans", lambda s: s["kind"] != "term")
    return unpacked(
        protect(docs, ["doc_id"], sanitised=False), *[f"n_{k}" for k in KINDS],
        F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), F.size("spans").cast("bigint").alias("n_spans"),
    )


def sanitised_documents(docs: DataFrame, text: str = "text") -> DataFrame:
    """The documents with sanitised texts; a column n_chars follows the text where it was its length."""
    rows = protect(docs, text=text)
    return with_text(rows, "sanitised", text)
