"""Quality rules as a ledger of failure bits.

Every rule is evaluated once per document. The ledger keeps the measurements and one
integer whose bits say which rules failed. Policies are versions: a named set of rules,
that is a mask. A verdict is `bits & mask == 0`, and what a policy would keep without one
of its rules follows from counts of the distinct bit patterns (at most 2 ** rules rows),
so that new policies and ablations never read a text again.

Cases. A null text has no words. A text of white space has none either: both fail
`few_words`. Equal rows get equal verdicts and both stay. Empty tables give empty results.
Columns of the documents that share a name with a measurement are kept apart (they travel
in a struct).
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetgauge.llm.common import field, map_bodies, saved, unpacked

WHITE = b"\x09\x0a\x0b\x0c\x0d\x20"
SYMBOLS = b"#*$%&|<>"
CONTINUATION = bytes(range(0x80, 0xC0))
WINDOW = 5

MEASURES = [
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_stutter", "n_upper", "n_letters",
]

#: Rules in the order of their bits; a rule holds the SQL condition of failing.
RULES = {
    "few_words": "n_words < 10",
    "repeated_windows": "100 * n_repeat_words > 20 * n_words",
    "many_symbols": "4 * n_symbols > n_words",
    "word_length": "n_words > 0 and (word_chars > 20 * n_words or word_chars < 2 * n_words)",
    "duplicate_lines": "n_lines >= 4 and 2 * n_dup_lines > n_lines",
    "stutter": "10 * n_stutter > 3 * n_words",
    "capitals": "n_letters > 0 and 2 * n_upper > n_letters",
}

#: Versions of the policy; later ones add rules.
POLICIES = {
    "base": ["few_words", "repeated_windows"],
    "v1": ["few_words", "repeated_windows", "many_symbols", "stutter"],
    "v2": list(RULES),
}
CURRENT = "v2"


def bit(rule: str) -> int:
    return 1 << list(RULES).index(rule)


def mask(policy: str) -> int:
    return sum(bit(rule) for rule in POLICIES[policy])


def repeated_words(words: list[bytes]) -> int:
    """Words that stand in a window of five that the text holds twice or more."""
    windows = list(zip(*(words[k:] for k in range(WINDOW))))
    if len(set(windows)) == len(windows):
        return 0
    counts, covered, end = Counter(windows), 0, 0
    for start, window in enumerate(windows):
        if counts[window] > 1:
            covered += start + WINDOW - max(start, end)
            end = start + WINDOW
    return covered


def measure(body: bytes | None) -> tuple[int, ...]:
    if not body:
        return (0,) * len(MEASURES)
    words = body.split()
    seen: set[bytes] = set()
    lines = repeats = 0
    for line in body.split(b"\n"):
        if line and not line.isspace():
            lines += 1
            repeats += line in seen
            seen.add(line)
    text = body.decode("utf-8", "replace")
    return (
        len(words),
        len(body.translate(None, WHITE + CONTINUATION)),
        len(body) - len(body.translate(None, SYMBOLS)),
        repeats,
        repeated_words(words),
        lines,
        sum(map(bytes.__eq__, words, words[1:])),
        sum(map(str.isupper, text)),
        sum(map(str.isalpha, text)),
    )


def ledger(docs: DataFrame, carry: list[str] | None = None, text: str = "text") -> DataFrame:
    """`row` (the carried columns), the measurements and `failed_bits`."""
    measured = map_bodies(
        docs, lambda bodies: list(zip(*map(measure, bodies))), [field(m, "bigint") for m in MEASURES], carry, text
    )
    bits = sum((F.when(F.expr(rule), bit(name)).otherwise(0) for name, rule in RULES.items()), F.lit(0))
    return measured.withColumn("failed_bits", bits.cast("int"))


def verdict(ledger_rows: DataFrame, policy: str = CURRENT):
    return F.col("failed_bits").bitwiseAND(F.lit(mask(policy))) == 0


def ablation(ledger_rows: DataFrame) -> DataFrame:
    """policy, rule, documents, rejected, rejected_by_rule_alone, kept_without_rule for each policy and each of its rules.

    One grouping by bit pattern; the rest is arithmetic over the patterns.
    """
    patterns = ledger_rows.groupBy("failed_bits").count()
    pairs = [(p, r, bit(r), mask(p)) for p, rules in POLICIES.items() for r in rules]
    rules = F.explode(F.array(*[
        F.struct(F.lit(p).alias("policy"), F.lit(r).alias("rule"), F.lit(b).alias("bit"), F.lit(m).alias("mask")) for p, r, b, m in pairs
    ]))
    failed = F.col("failed_bits").bitwiseAND(F.col("x.mask"))
    one = lambda condition: F.sum(F.when(condition, F.col("count")).otherwise(0))
    return (
        patterns.select("failed_bits", "count", rules.alias("x"))
        .groupBy(F.col("x.policy").alias("policy"), F.col("x.rule").alias("rule"))
        .agg(
            F.sum("count").alias("documents"),
            one(failed != 0).alias("rejected"),
            one(failed == F.col("x.bit")).alias("rejected_by_rule_alone"),
            one(failed.bitwiseAND(F.bitwise_not(F.col("x.bit"))) == 0).alias("kept_without_rule"),
        )
    )


def quality_report(docs: DataFrame, policy: str = CURRENT) -> DataFrame:
    """doc_id, the base measurements, base_failed, kept, the other measurements and failed_bits; then, from the stored ledger, every policy's verdict and the ablation.

    `lone_rule` is the rule without which the policy would keep the document (null if it
    keeps it, or if several rules fail), and `lone_rejects` the documents that this rule
    alone rejects.
    """
    rows = saved(ledger(docs, ["doc_id"]), "ledger")
    base = F.col("failed_bits").bitwiseAND(F.lit(mask("base"))) != 0
    alone = ablation(rows).where(F.col("policy") == policy).select(F.col("rule").alias("lone_rule"), F.col("rejected_by_rule_alone").alias("lone_rejects"))
    failed = F.col("failed_bits").bitwiseAND(F.lit(mask(policy)))
    lone = F.coalesce(*[F.when(failed == bit(rule), F.lit(rule)) for rule in POLICIES[policy]])
    judged = rows.withColumns({f"kept_{p}": verdict(rows, p) for p in POLICIES}).withColumn("lone_rule", lone)
    return unpacked(
        judged.join(F.broadcast(alone), "lone_rule", "left"),  # a row for each rule
        "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"),
        (~base & verdict(rows, policy)).alias("kept"), "n_lines", "n_stutter", "n_upper", "n_letters", "failed_bits",
        *[f"kept_{p}" for p in POLICIES], "lone_rule", "lone_rejects",
    )


def keep_good(docs: DataFrame, policy: str = CURRENT) -> DataFrame:
    """The documents, as they are, that the policy keeps."""
    rows = ledger(docs)
    return unpacked(rows.where(verdict(rows, policy)))
