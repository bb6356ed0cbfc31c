"""The pipeline, stage by stage, against plain versions of its operators."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import pytest
from hard_rows import HARD
from test_corpus_operators import ids_of, plain_components, plain_lines
from test_text_operators import plain_spans

import corpus_pipeline
from __spark_entry__ import oracle_sql, queries
from fleetgauge.llm import packing, quality

FOLDER = "/root/testdata/sf0.001"


def table(spark, rows, path):
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, row string")
    docs.write.parquet(path)
    return spark.read.parquet(path)


def test_stages_against_plain(shipped, tmp_path):
    source = shipped.read.parquet(f"{FOLDER}/documents.parquet").collect()
    rows = [(r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"], "x") for r in source]
    rows += [(10_000 + k if i is not None else None, t, None, None, None, "y") for k, (i, t) in enumerate(HARD)] + rows[:3]
    for k in range(6):  # near copies by five words that are far from each other by two bits of a fingerprint
        words = [f"{chr(97 + k)}{j}word" for j in range(120)]
        rows += [(20_000 + 10 * k + n, " ".join([*words[: 20 * n], *[f"other{n}"] * (n > 0), *words[20 * n + (n > 0) :]]), None, None, None, "x") for n in range(3)]
    docs = table(shipped, rows, f"{tmp_path}/0")
    state = [r[:2] for r in rows]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(shipped, docs, FOLDER)
        if name == "quality_rules":
            keep = lambda t: not any(quality_failures(t))
            state = [r for r in state if keep(r[1])]
        elif name == "line_dedup":
            state = [(i, cut(t, drop)) for (i, t), (_, _, drop) in zip(state, plain_lines(state))]
        elif name == "near_dedup":
            state = one_of_each(state)
            assert sorted(i for i, _ in state if i and i >= 20_000) == [20_000 + 10 * k for k in range(6)]
        elif name == "pii":
            state = [(i, masked(t)) for i, t in state]
        if name == "best_fit_packing":
            got = Counter((r["doc_id"], r["piece"], r["start"], r["length"]) for r in out.collect())
            assert got == Counter((i, k, *p) for i, t in state for k, p in enumerate(packing.cut(len(ids_of(t)))))
        else:
            assert out.columns == docs.columns
            out.write.parquet(f"{tmp_path}/{k + 1}")
            docs = shipped.read.parquet(f"{tmp_path}/{k + 1}")
            got = docs.collect()
            assert Counter((r["doc_id"], r["text"]) for r in got) == Counter(state), name
            assert {r["row"] for r in got} <= {"x", "y"}
            assert all(r["n_chars"] is None or r["n_chars"] == len(r["text"]) for r in got)


def quality_failures(text):
    measures = dict(zip(quality.MEASURES, quality.measure(None if text is None else text.encode())))
    n = measures["n_words"]
    yield n < 10
    yield 100 * measures["n_repeat_words"] > 20 * n
    yield 4 * measures["n_symbols"] > n
    yield n > 0 and not 2 * n <= measures["word_chars"] <= 20 * n
    yield measures["n_lines"] >= 4 and 2 * measures["n_dup_lines"] > measures["n_lines"]
    yield 10 * measures["n_stutter"] > 3 * n
    yield measures["n_letters"] > 0 and 2 * measures["n_upper"] > measures["n_letters"]


def cut(text, drop):
    gone = {int(n) for n in drop.split(",") if n}
    return None if text is None else "\n".join(x for k, x in enumerate(text.split("\n")) if k not in gone)


def one_of_each(state):
    """Of documents that similar ones connect (five-word shingles, Jaccard 0.8) the one with the smallest id."""
    def shingles(text):
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
        return frozenset(tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))) if words else frozenset()

    sets = {r: shingles(r[1]) for r in state}
    distinct = sorted(set(sets.values()), key=lambda x: (len(x), sorted(x)))
    where = defaultdict(list)
    for k, own in enumerate(distinct):
        for shingle in own:
            where[shingle].append(k)
    pairs = {(a, b) for held in where.values() for a in held for b in held if a < b}
    links = [(a, b) for a, b in pairs if 5 * len(distinct[a] & distinct[b]) >= 4 * len(distinct[a] | distinct[b])]
    root, best = plain_components(links, range(len(distinct))), {}
    place = {own: root[k] for k, own in enumerate(distinct)}
    for r in sorted(state, key=lambda r: (r[0] is None, r[0] or 0)):
        best.setdefault(place[sets[r]], r)
    return list(best.values())


def masked(text):
    """Nothing discloses in so few rows; only the patterns are replaced."""
    if text is None:
        return None
    out, at = [], 0
    for a, b, kind in plain_spans(text):
        if a >= at:
            out += [text[at:a], f"<{kind.upper()}>"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def test_run_and_registration(shipped):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "near_dedup", "pii", "best_fit_packing"]
    names = queries()
    assert names["pipeline"] is corpus_pipeline.run and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 14))
    assert "pipeline" not in oracle_sql()
    rows = corpus_pipeline.run(shipped, FOLDER)
    assert rows.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] and rows.count() > 0


@pytest.mark.parametrize("stage", [s for _, s in corpus_pipeline.STAGES])
def test_stage_of_an_empty_table(shipped, stage):
    docs = shipped.createDataFrame([], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    assert stage(shipped, docs, FOLDER).collect() == []
