"""Quality, licenses, personal data, languages and pieces against plain versions."""

from __future__ import annotations

import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import pytest
from hard_rows import HARD

from fleetgauge.llm import language, license_scan, pieces, pii, quality
from fleetgauge.llm.registry import tokenizer

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def plain_quality(text):
    text = text or ""
    words = WORDS.findall(text)
    windows = [tuple(words[k : k + 5]) for k in range(len(words) - 4)]
    counts = Counter(windows)
    covered = {k + j for k, w in enumerate(windows) if counts[w] > 1 for j in range(5)}
    lines = [x for x in text.split("\n") if WORDS.search(x)]
    return (
        len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)),
        sum(x in lines[:k] for k, x in enumerate(lines)), len(covered), len(words) < 10 or 100 * len(covered) > 20 * len(words),
    )


def test_quality_measures(documents, small):
    table, rows = small
    got = {r["doc_id"]: r for r in quality.quality_report(table).collect()}
    for r in rows:
        g = got[r["doc_id"]]
        want = plain_quality(r["text"])
        assert (g["n_words"], g["word_chars"], g["n_symbols"], g["n_dup_lines"], g["n_repeat_words"], g["base_failed"]) == want
        assert g["kept"] is False or not want[-1]


def test_quality_hard_rows(documents):
    docs = documents(*HARD)
    got = sorted(map(tuple, quality.quality_report(docs).select("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect()))
    assert got == sorted(plain_quality(t) for _, t in HARD)


def test_quality_keeps_columns_and_rows(documents):
    text = "these are ten quite different words in one plain line"
    docs = documents((1, text), (1, text), (2, "too few"), (3, "*** " * 30), (None, text), clash=("n_words", "row", "failed_bits"))
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns and kept.schema == docs.schema
    assert sorted((r["doc_id"] or 0, r["n_words"]) for r in kept.collect()) == [(0, "n_words!"), (1, "n_words!"), (1, "n_words!")]


def test_quality_ablation_counts(documents, small):
    table, rows = small
    ledger = quality.ledger(table, ["doc_id"])
    bits = [r["failed_bits"] for r in ledger.collect()]
    for r in quality.ablation(ledger).collect():
        mask, bit = quality.mask(r["policy"]), quality.bit(r["rule"])
        assert r["documents"] == len(bits)
        assert r["rejected"] == sum(bool(b & mask) for b in bits)
        assert r["rejected_by_rule_alone"] == sum(b & mask == bit for b in bits)
        assert r["kept_without_rule"] == sum(not b & mask & ~bit for b in bits)


def plain_license(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    starts, labels = [], set()
    for phrase, label in license_scan.PHRASES.items():
        p = phrase.split()
        found = [k for k in range(len(words)) if words[k : k + len(p)] == p]
        starts += found
        labels |= {label} if found else set()
    return len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels))


def test_license_base(documents, small):
    table, rows = small
    extra = [(900 + k, t) for k, t in enumerate(["MIT License mit license", "the General-Public license, apache_license", "mit licenses mit  LICENSE", "é mit license é"])]
    texts = [(r["doc_id"], r["text"]) for r in rows] + extra + [x for x in HARD if x[0]]
    got = sorted(map(tuple, license_scan.license_report(documents(*texts)).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels").collect()), key=repr)
    assert got == sorted([(i, *plain_license(t)) for i, t in texts], key=repr)


@pytest.mark.parametrize(("text", "labels", "edits"), [
    ("Released under the MIT License.", "mit", 0),
    ("so it is releasd under the mit license, they say", "mit", 1),
    ("Licensed under the Apache License, Version 2.0.", "apache,apache-2.0", 0),
    ("Lizensed under the Apache Licence, Version 2.0.", "apache-2.0", 2),
    ("Licensed under CC BY-NC 4.0.", "cc-by-nc-4.0", 0),
    ("all right reserved", "all-rights-reserved", 1),
    ("no rights reserved at all", "", None),
    ("a licensed driver under the bridge", "", None),
])
def test_license_notices(text, labels, edits):
    found = license_scan.scan_one(text.encode())
    assert ",".join(found[5]) == labels
    if edits is not None:
        span = found[7][0]
        assert span["edits"] == edits
        shown = text[span["start"] : span["end"]]
        assert shown == shown.strip() and len(shown.split()) >= 3


def test_license_notices_side_by_side():
    found = license_scan.scan_one(b"x all right reserved x all rights reserved")
    assert [(n["first_word"], n["edits"]) for n in found[7]] == [(1, 1), (5, 0)]
    first, second = "licensed under the gnu general publik licence version 3", "licensed under the gnu general public license version 2"
    found = license_scan.scan_one(f"{first} {second}".encode())
    assert [(n["label"], n["edits"]) for n in found[7]] == [("gpl-3.0", 2), ("gpl-2.0", 0)]


def least_edits(notice, words):
    """For each word at which a span may begin: the fewest edits between the notice and any run of whole words from there."""
    out = []
    for i in range(len(words)):
        best = len(notice)
        for j in range(i + 1, min(len(words), i + len(notice.split()) + 3) + 1):
            text = " ".join(words[i:j])
            row = list(range(len(text) + 1))
            for a, x in enumerate(notice, 1):
                new = [a]
                for b, y in enumerate(text, 1):
                    new.append(min(row[b - 1] + (x != y), row[b] + 1, new[-1] + 1))
                row = new
            best = min(best, row[-1])
        out.append(best)
    return out


@pytest.mark.parametrize("notice", ["all rights reserved", "released under the mit license", "gnu affero general public license"])
def test_license_fuzzy_against_every_place(monkeypatch, notice):
    """Random texts of damaged notices: whatever edit distance finds at some place is found, and nothing else."""
    monkeypatch.setattr(license_scan, "NOTICES", {notice: "x"})
    license_scan.searches.cache_clear()
    dice, found = random.Random(len(notice)), 0
    for _ in range(60):
        words = dice.choices(["some", "rights", "the", "license", "of", "a", notice.split()[0]], k=dice.randrange(8))
        for _ in range(dice.randrange(1, 4)):
            damaged = list(notice)
            for _ in range(dice.randrange(5)):
                k, kind = dice.randrange(len(damaged)), dice.randrange(3)
                damaged[k : k + (kind != 1)] = [] if kind == 0 else [dice.choice("abz ")]
            words += "".join(damaged).split() + dice.choices(["some", "the", "of"], k=dice.randrange(3))
        most = license_scan.max_edits(notice)
        least = least_edits(notice, words)
        spans = license_scan.scan_one(" ".join(words).encode())[7]
        near = [k for k, n in enumerate(least) if n <= most]
        assert all(least[s["first_word"]] <= s["edits"] <= most for s in spans)
        assert all(any(s["first_word"] - most <= k <= s["last_word"] + most for s in spans) for k in near)
        clear = [k for k in near if all(abs(k - j) >= len(notice.split()) for j in near if j != k)]
        assert all(any(s["edits"] <= least[k] and s["first_word"] <= k <= s["last_word"] for s in spans) for k in clear)
        found += len(spans)
    license_scan.searches.cache_clear()
    assert found > 40


def test_license_time_follows_the_text():
    """Thousands of damaged notices in one text, one after the other."""
    took = []
    for n in (1000, 4000):
        body = b"all right reserved " * n
        start = time.process_time()
        found = license_scan.scan_one(body)
        took.append(time.process_time() - start)
        assert [s["first_word"] for s in found[7]] == list(range(0, 3 * n, 3))
        assert (found[7][-1]["start"], found[7][-1]["end"]) == (19 * n - 19, 19 * n - 1)
    assert took[1] < 8 * took[0] + 0.5


def test_license_pieces_cover_notices():
    for notice in license_scan.NOTICES:
        parts = license_scan.pieces(notice)
        assert "".join(p for _, p in parts) == notice and len(parts) == license_scan.max_edits(notice) + 1


EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain_spans(text):
    digits = lambda m: re.sub("[^0-9]", "", m.group())

    def luhn(d):
        return sum(sum(divmod(2 * int(c), 10)) if k % 2 else int(c) for k, c in enumerate(d[::-1])) % 10 == 0

    out = [(m.start(), 0, m.end(), "email") for m in EMAIL.finditer(text)]
    out += [(m.start(), 1, m.end(), "ip") for m in IP.finditer(text) if all(int(p) <= 255 for p in m.group().split("."))]
    out += [(m.start(), 2, m.end(), "card") for m in CARD.finditer(text) if 14 <= len(digits(m)) <= 19 and luhn(digits(m))]
    out += [(m.start(), 3, m.end(), "phone") for m in PHONE.finditer(text) if 10 <= len(digits(m)) <= 15]
    return [(a, b, k) for a, _, b, k in sorted(out)]


TRICKY = [
    "a@b.c@d.e f@g h@i-j.k.l.", "@x.y a@.b a@b..c %+-@9.9", "1.2.3.4.5.6.7.8 256.1.1.1 001.002.003.004 1.1.1", "9999.9.9.9.9",
    "4111 1111 1111 1111 and 4111-1111-1111-1112, 41111111111111111111111", "+1 (386) 555-3733 +12345678901234567 +1 2", "é a.b@c.d é +44 20 7946 0958",
    "x" * 5000 + "@" + "y" * 5000 + ".z", "1" * 3000,
]


@pytest.mark.parametrize("text", TRICKY)
def test_pii_patterns(text):
    assert pii.base_spans(text) == plain_spans(text)


def test_pii_report(documents, small):
    table, rows = small
    texts = [(r["doc_id"], r["text"]) for r in rows] + HARD + [(500 + k, t) for k, t in enumerate(TRICKY)]
    got = {(r["doc_id"], r["base_sha256"]): r for r in pii.pii_report(documents(*texts)).collect()}
    assert len(pii.pii_report(documents(*texts)).collect()) == len(texts)
    for i, text in texts:
        spans = plain_spans(text or "")
        r = got[i, hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, b, k in spans).encode()).hexdigest()]
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(s[2] == k for s in spans) for k in pii.KINDS]


def disclosing_corpus():
    filler = [f"plain line number {k} of common words and nothing else" for k in range(300)]
    secret = [f"row {k}: the accountant Zwingli wrote to a.b@c.org about item {k}" for k in range(6)]
    others = [f"someone wrote a note about item {k} to x{k}@y.org" for k in range(40)]
    docs = [(k, t) for k, t in enumerate(filler + secret + others)]
    return docs + [(900, "Zwingli alone, without an address"), (901, "again Zwingli and a.b@c.org here")]


def plain_words(line):
    """Words in lower case without these signs at their ends, and where they stand."""
    found = []
    for m in re.finditer(r"\S+", line):
        word = m.group().lower().strip(".,;:!?()[]{}<>\"'|*#$%&")
        if word:
            found.append((m.start(), m.end(), word))
    return found


def plain_entities(line):
    for a, b, kind in plain_spans(line):
        value = line[a:b].lower() if kind in ("email", "ip") else re.sub("[^0-9]", "", line[a:b])
        yield f"{kind}:{value}", a, b


def plain_disclosures(texts, support=3, least=0.8):
    """(entity, term) of what discloses, from the definition: distinct lines as contexts."""
    lines = {line for text in texts for line in text.split("\n")}
    n_term = Counter(t for line in lines for t in {w for _, _, w in plain_words(line)})
    with_entity, pairs = defaultdict(set), defaultdict(set)
    for line in lines:
        words = plain_words(line)
        spans = defaultdict(list)
        for e, a, b in plain_entities(line):
            spans[e].append((a, b))
        for e, places in spans.items():
            with_entity[e].add(line)
            for t in {w for x, y, w in words if not any(x < b and y > a for a, b in places)}:
                pairs[e, t].add(line)
    out = {}
    for (e, t), own in pairs.items():
        n_e = len(with_entity[e])
        if len(own) >= support and len(lines) > n_e:
            d = math.log(len(lines) * len(own) / n_e / n_term[t]) / math.log(len(lines) / n_e)
            if d >= least:
                out[e, t] = d
    return out


def check_disclosures(corpus, rows):
    want = plain_disclosures([t or "" for _, t in corpus])
    for i, text in corpus:
        text = text or ""
        held = {e for line in text.split("\n") for e, _, _ in plain_entities(line)}
        flagged = {t for e, t in want if e in held}
        base = plain_spans(text)
        expect = sorted((x, y) for x, y, w in plain_words(text) if w in flagged and not any(x < b and y > a for a, b, _ in base))
        shown = sorted((int(a), int(b)) for k, a, b in (s.split(":") for s in rows[i]["spans"].split(",") if s) if k == "term")
        assert len(shown) == len(expect) and all(x <= a < b <= y for (a, b), (x, y) in zip(shown, expect))
        assert rows[i]["n_spans"] == len(shown) + len(base)
    return want


def test_pii_disclosing_terms(documents):
    corpus = disclosing_corpus()
    rows = {r["doc_id"]: r for r in pii.pii_report(documents(*corpus)).collect()}
    want = check_disclosures(corpus, rows)
    assert ("email:a.b@c.org", "zwingli") in want and all(t != "item" for _, t in want)
    assert rows[900]["spans"] == ""


@pytest.mark.parametrize(("seed", "sample"), [(1, 64), (2, 1), (3, 2)])
def test_pii_disclosures_of_random_lines(documents, monkeypatch, seed, sample):
    """Lines with several entities, copies, common words and words of one entity; also where all lines are in the sample."""
    monkeypatch.setattr(pii, "SAMPLE", sample)
    rng = random.Random(seed)
    common, entities = [f"w{k}" for k in range(60)], [f"p{k}@q.org" for k in range(6)] + ["10.0.0.7", "+1 386 555 3733"]
    texts = []
    for k in range(150):
        lines = []
        for _ in range(rng.randrange(1, 5)):
            words = rng.choices(common, k=rng.randrange(3, 12))
            if rng.random() < 0.35:
                e = rng.randrange(len(entities))
                words.insert(rng.randrange(len(words)), entities[e])
                words += [f"own{e}"] * (rng.random() < 0.8) + [f"half{e % 3}"] * (rng.random() < 0.5)
            lines.append(" ".join(words))
        texts.append("\n".join(lines))
    texts += rng.choices(texts, k=60)
    corpus = list(enumerate(texts))
    rows = {r["doc_id"]: r for r in pii.pii_report(documents(*corpus)).collect()}
    want = check_disclosures(corpus, rows)
    assert {f"own{k}" for k in range(8)} <= {t for _, t in want} and not any(t.startswith("w") for _, t in want)


def test_pii_terms_far_from_the_entity(documents):
    """Terms count over the whole line, also more than 400 characters away and behind a long token without spaces."""
    far = [(500 + k, f"Zwingli {k}\t{'x' * 900}\tto far@away.org about {'and then ' * 90}Oecolampad") for k in range(4)]
    rows = {r["doc_id"]: r for r in pii.pii_report(documents(*disclosing_corpus()[:300], *far)).collect()}
    assert all(r["spans"].count("term:") >= 2 for i, r in rows.items() if i >= 500)


def test_pii_copies_hide_no_term(documents):
    corpus = disclosing_corpus()
    copies = [(2000 + k, corpus[301][1]) for k in range(200)]
    rows = pii.pii_report(documents(*corpus, *copies)).collect()
    assert all("term:" in r["spans"] for r in rows if r["doc_id"] == 301 or r["doc_id"] >= 2000)


def test_pii_sanitised_documents(documents):
    corpus = [*disclosing_corpus(), (950, None), (951, ""), (952, "clean text")]
    docs = documents(*corpus, clash=("body", "spans", "sanitised"))
    out = pii.sanitised_documents(docs)
    assert out.schema == docs.schema
    rows = {r["doc_id"]: r for r in out.collect()}
    assert "a.b@c.org" not in rows[901]["text"] and "Zwingli" not in rows[901]["text"] and "<EMAIL>" in rows[901]["text"]
    assert rows[952]["text"] == "clean text" and rows[950]["text"] is None and rows[951]["text"] == ""
    assert all(r["n_chars"] is None or r["n_chars"] == len(r["text"]) for r in rows.values())


def plain_language(rows):
    def grams(text):
        words = ["".join(c.lower() if len(c.lower()) == 1 else c for c in w) for w in "".join(c if c.isalpha() else " " for c in text or "").split()]
        line = " " + " ".join(words) + " " if words else ""
        return Counter(c for c in line if c != " ") + Counter(line[k : k + 2] for k in range(len(line) - 1)) + Counter(line[k : k + 3] for k in range(len(line) - 2))

    order = lambda g: sum(ord(c) << 21 * (len(g) - 1 - k) for k, c in enumerate(g))
    top = lambda counts: [g for g, _ in sorted(counts.items(), key=lambda x: (-x[1], order(x[0])))][: language.PROFILE]
    held = {r[0]: r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 1 for r in rows}
    counts = defaultdict(Counter)
    for i, text, lang in rows:
        if lang is not None and not held[i]:
            counts[lang].update(grams(text))
    learnt = {n: {g: k for k, g in enumerate(top(c))} for n, c in counts.items()}
    out = {}
    for i, text, _ in rows:
        mine = top(grams(text))
        apart = {n: sum(abs(p[g] - k) if g in p else language.PROFILE for k, g in enumerate(mine)) for n, p in learnt.items()}
        best = min(sorted(apart), key=apart.get) if mine and apart else None
        out[i] = (held[i], best or "und", 1 - apart[best] / (language.PROFILE * len(mine)) if best else 0.0)
    return out


def test_language_against_plain(documents, small):
    _, rows = small
    texts = [(r["doc_id"], r["text"], r["lang"]) for r in rows] + [(5000 + k, t, None) for k, (_, t) in enumerate(HARD)]
    want = plain_language(texts)
    got = language.language_report(documents(*texts)).collect()
    assert len(got) == len(texts)
    for r in got:
        assert (r["held_out"], r["lang_pred"]) == want[r["doc_id"]][:2]
        assert abs(r["score"] - want[r["doc_id"]][2]) < 1e-9


def test_language_held_out_accuracy(shipped):
    table = shipped.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = language.language_report(table).where("held_out").join(table.select("doc_id", "lang"), "doc_id").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in rows) > 0.97 * len(rows)


def test_language_without_labels(documents):
    got = language.language_report(documents((0, "some text", None), (1, None, None))).collect()
    assert {(r["lang_pred"], r["score"]) for r in got} == {("und", 0.0)}


def model():
    return tokenizer("piece_bpe_32k.model")


def test_pieces_match_the_library(documents, small):
    import random

    import sentencepiece

    table, rows = small
    dice = random.Random(5)
    bits = [*"abcdeThe  \n\t.,'0189()<>", "▁", "é", "ß", "中", "文", "\U0001f642", "ﬁ", "\x00", "​", "the", "ing", "     ", " " * 40, "\r\n", "привет"]
    texts = [r["text"] for r in rows] + ["".join(dice.choice(bits) for _ in range(dice.randint(0, 60))) for _ in range(2000)]
    texts += [" " * k for k in range(70)] + ["a" + " " * k + "b" for k in range(70)] + [" " * k + "ﬁ" for k in range(70)] + [t for _, t in HARD if t is not None]
    got = pieces.vocabulary(model()).encode(texts)
    want = sentencepiece.SentencePieceProcessor(model_file=model()).encode(texts)
    assert [g.tolist() for g in got] == want


def test_pieces_report_and_decoding(documents):
    docs = documents(*HARD)
    rows = pieces.encoded(docs, model(), ["doc_id", "text"], check=True)
    assert {r["round_trip"] for r in rows.collect()} == {True, None}
    back = pieces.decoded(rows.select("row", "ids"), model(), carry=["row"]).collect()
    for r in back:
        text = r["row"]["row"]["text"]
        assert r["decoded"] == (None if text is None else text.replace("▁", " "))
    assert pieces.pieces_report(docs, model()).count() == len(HARD)


@pytest.mark.parametrize("report", [quality.quality_report, license_scan.license_report, pii.pii_report, language.language_report, lambda d: pieces.pieces_report(d, model())])
def test_empty_table(documents, report):
    assert report(documents()).collect() == []
