"""Whitening, token counts and periodic runs against plain versions and the library."""

from __future__ import annotations

import hashlib
import json
import math
import random
import re
import zlib

import numpy as np
import pytest
from hard_rows import HARD
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetgauge.llm import bytelevel, runs, token_counts, whitening
from fleetgauge.llm.registry import tokenizer

# ---- periodic runs


def plain_runs(words):
    """Every maximal stretch by its definition: lag by lag, without those that have a smaller period."""
    n, out = len(words), []
    for q in range(1, n // 4 + 1):
        i = q
        while i < n:
            if words[i] != words[i - q]:
                i += 1
                continue
            j = i
            while j < n and words[j] == words[j - q]:
                j += 1
            start, length = i - q, j - i + q
            smaller = any(all(words[k] == words[k - p] for k in range(start + p, start + length)) for p in range(1, q))
            if length >= max(6, 4 * q) and not smaller:
                out.append((start, length, q))
            i = j
    return sorted(out, key=lambda r: (r[0], r[2]))


def plain_report(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = plain_runs(words)
    gone = {k for s, length, q in found for k in range(s + q, s + length)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (
        doc_id, len(found), *(best or (None, None, None)), 1000 * best[1] // best[2] if best else None,
        digest("".join(f"{s},{length},{q}\n" for s, length, q in found)), digest(" ".join(w for k, w in enumerate(words) if k not in gone)),
    )


@pytest.mark.parametrize("letters", [1, 2, 3, 6])
def test_runs_against_plain(letters):
    rng = random.Random(letters)
    for _ in range(700):
        n = rng.randrange(100)
        words = [bytes([97 + rng.randrange(letters)]) for _ in range(n)]
        if n > 8 and rng.random() < 0.6:
            a = rng.randrange(n)
            p = 1 + rng.randrange(max(1, (n - a) // 3))
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        if n and rng.random() < 0.3:
            words[rng.randrange(n)] = b"z"
        assert runs.runs(words) == plain_runs(words)


def test_contexts_prove_every_lag_of_their_level():
    """Two periods at least, and within the matches of any run of the lag."""
    seen = []
    for low, high, context in runs.levels(10**9):
        seen += [(low, high)]
        for lag in {low, high}:
            assert 2 * lag <= context <= max(runs.LEAST, runs.POWER * lag) - lag
    assert all(high + 1 == low for (_, high), (low, _) in zip(seen, seen[1:])) and seen[0][0] == 1


def test_long_texts_cost_their_length():
    assert runs.runs([b"a"] * 200_000) == [(0, 200_000, 1)]
    line = [b"%d" % k for k in range(997)]
    assert runs.runs(line * 200) == [(0, 997 * 200, 997)]
    apart = [w for k in range(300) for w in (*line[:40], b"n%d" % k, *([b"x"] * (k % 7)))]
    assert [r for r in runs.runs(apart) if r[2] > 1] == [] and len(runs.runs(apart)) == 300 // 7


def test_runs_report(documents, small):
    _, rows = small
    texts = [(r["doc_id"], r["text"]) for r in rows if len(r["text"] or "") < 12_000] + HARD[:6] + HARD[8:]
    texts += [(5000 + k, "a b c " * 30 + "x " * k) for k in range(40)]
    got = sorted(map(tuple, runs.runs_report(documents(*texts)).collect()), key=repr)
    assert got == sorted([plain_report(*t) for t in texts], key=repr)
    assert sum(zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in texts) > 10


def test_runs_over_lines_and_collapsed_text(documents):
    docs = documents((1, "go " * 6 + "on"), (2, "to be\tor\nto be or to be or to be or not"), (None, None), (3, " \n"), clash=("n_runs", "row", "id"))
    got = {r["row"]["doc_id"]: r for r in runs.found_runs(docs).collect()}
    assert got[1]["collapsed"] == "go on" and (got[1]["start"], got[1]["length"], got[1]["period"]) == (0, 6, 1)
    assert got[2]["collapsed"] == "to be or not" and got[2]["n_runs"] == 1 and got[2]["row"]["id"] == "id!"
    assert got[None]["collapsed"] == "" and got[3]["n_runs"] == 0 and got[3]["period"] is None


# ---- token counts


def plain_count(text):
    return len(bytelevel.library(tokenizer())[0].encode(text or "", add_special_tokens=False))


def mixed_texts(n=150, seed=3):
    rng = random.Random(seed)
    parts = [
        "the ", "  ", "\n", "\n\n ", "don't", "we're ", "<|endoftext|>", "<|endof", "text|>", "12", "ü中", "'", "'r", "e", " ", "é ", "\x1c", "á",
        "\U0001f642", "....", " \t", " ", " x", "中文 字",
    ]
    return ["".join(rng.choice([*parts, "x" * rng.randint(1, 200)]) for _ in range(rng.randrange(400))) for _ in range(n)]


@pytest.mark.parametrize(("chunk", "overlap", "huge"), [(16_384, 512, 32_768), (64, 40, 64), (200, 30, 300), (50, 9, 100)])
def test_token_counts_are_the_librarys(documents, chunk, overlap, huge):
    texts = [*mixed_texts(), "x" * 5000, "word " * 2000, " " * 3000, "\n" * 3000 + "a", "<|endoftext|>" * 300, "x" * 5000]
    docs = documents(*enumerate(texts))
    got = {r["row"]["doc_id"]: (r["n_bytes"], r["n_tokens"]) for r in token_counts.token_counts(docs, tokenizer(), ["doc_id"], chunk=chunk, overlap=overlap, huge=huge).collect()}
    assert got == {k: (len(t.encode()), plain_count(t)) for k, t in enumerate(texts)}


def test_overlaps_without_a_common_word_are_widened(shipped):
    """A word over many chunks: its chunks join, those around it stay."""
    path, text = tokenizer(), "some words here " * 20 + "y" * 3000 + " and more words after it" * 20
    docs = shipped.createDataFrame([(text,)], "text string")
    got = token_counts.huge_counts(docs, path, "text", 100, 40, 100).collect()
    assert [r["n_tokens"] for r in got] == [plain_count(text)]
    rows = [("k", s, s + 100 if s + 100 < len(text) else None, min(len(text), s + 140), len(text), text[s : s + 140]) for s in range(0, len(text), 100)]
    parts = token_counts.encoded(shipped.createDataFrame(rows, token_counts.CHUNKS), path, 40)
    state = {r["start"]: r["pos"] for r in token_counts.spliced(parts).collect()}
    inside = [s for s in state if 320 < s + 100 < 3280]
    assert inside and all(state[s] is None for s in inside) and state[0] is not None
    assert all(text[p] == " " for s, p in state.items() if p is not None and s not in inside)


def test_token_report_on_documents(documents, small):
    table, rows = small
    got = sorted(map(tuple, token_counts.tokens_report(table, tokenizer()).collect()))
    assert got == sorted((r["doc_id"], len((r["text"] or "").encode()), n := plain_count(r["text"]), n > 512) for r in rows)
    hard = sorted(map(tuple, token_counts.tokens_report(documents(*HARD, clash=("n_tokens", "key", "body")), tokenizer()).collect()), key=repr)
    assert hard == sorted(((i, len((t or "").encode()), n := plain_count(t), n > 512) for i, t in HARD), key=repr)


def test_unproven_tokenizers_are_refused(tmp_path):
    with open(tokenizer(), encoding="utf-8") as f:
        spec = json.load(f)
    for k, change in enumerate([
        {"normalizer": {"type": "Lowercase"}}, {"pre_tokenizer": {"type": "Whitespace"}},
        {"added_tokens": [{**spec["added_tokens"][0], "lstrip": True}]}, {"added_tokens": [{**spec["added_tokens"][0], "content": "a b"}]},
    ]):
        path = tmp_path / f"{k}.json"
        path.write_text(json.dumps(spec | change))
        with pytest.raises(ValueError, match="it has|its words|the added token"):
            bytelevel.library(str(path))
        with pytest.raises(ValueError):
            bytelevel.encoder(str(path))


def test_both_libraries_class_every_character_alike():
    """The splitting pattern sees a character's class alone: equal ids around every character prove equal classes."""
    library, encoder = bytelevel.library(tokenizer())[0], bytelevel.encoder(tokenizer())
    points = [c for c in range(0x32400) if not 0xD800 <= c < 0xE000] + list(range(0xE0000, 0xE0200)) + [0x10FFFF]
    for k in range(0, len(points), 20_000):
        texts = [f"a{chr(c)}a 1{chr(c)}1,{chr(c)} {chr(c)}b" for c in points[k : k + 20_000]]
        both = zip(library.encode_batch_fast(texts, add_special_tokens=False), encoder.encode_batch(texts, allowed_special="all", num_threads=1))
        assert all(a.ids == b for a, b in both)


# ---- whitening


def plain_whitening(vectors):
    """n, deviations, whitened (up to sign) and explained, by numpy's own eigenvectors."""
    x = np.floor(np.array(vectors, np.float64) * 1024).astype(np.int64) + 100_000
    n, total = len(x), x.sum(axis=0)
    deviations = [sum((n * int(a) - int(s)) ** 2 for a, s in zip(row, total)) for row in x]
    centred = x - total / n
    values, components = np.linalg.eigh(centred.T @ centred / n)
    values, components = values[::-1][:8], components[:, ::-1][:, :8]
    return n, deviations, centred @ components / np.sqrt(values), values / np.trace(centred.T @ centred / n)


VECTORS = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("n", T.StringType()), T.StructField("component", T.StringType())])


def table(spark, vectors, ids=None):
    rows = [(k if ids is None else ids[k], None if v is None else [None if c is None else float(c) for c in v], "n!", "c!") for k, v in enumerate(vectors)]
    return spark.createDataFrame(rows, VECTORS).repartition(3)


def test_whitening_against_numpy(shipped):
    vectors = np.random.default_rng(5).standard_normal((300, 12)).astype(np.float32) * np.linspace(1, 3, 12, dtype=np.float32)
    extra = [None, [], [None] * 12, [math.nan] * 12, [math.inf] * 12, [1.0] * 5]
    got = whitening.whitening_report(table(shipped, [*vectors.tolist(), *extra])).collect()
    n, deviations, white, explained = plain_whitening(vectors)
    assert len(got) == 300 * 8 and {r["n"] for r in got} == {n}
    found = np.zeros((300, 8))
    for r in got:
        found[r["vec_id"], r["component"] - 1] = r["whitened"]
        assert r["deviation"] == deviations[r["vec_id"]]
        assert math.isclose(r["explained"], explained[r["component"] - 1], rel_tol=1e-10)
    signs = np.sign((found * white).sum(axis=0))
    assert np.allclose(found, white * signs, atol=1e-9)
    assert {r["identity_error"] for r in got} == {got[0]["identity_error"]} and got[0]["identity_error"] < 1e-10


def test_whitening_on_embeddings(shipped):
    rows = shipped.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    vectors = {r["vec_id"]: r["embedding"] for r in rows.collect()}
    n, deviations, white, explained = plain_whitening(list(vectors.values()))
    place = {i: k for k, i in enumerate(vectors)}
    got = whitening.whitening_report(rows).collect()
    found = np.zeros((n, 8))
    for r in got:
        found[place[r["vec_id"]], r["component"] - 1] = r["whitened"]
        assert r["deviation"] == deviations[place[r["vec_id"]]]
    assert len(got) == 8 * n and np.allclose(found, white * np.sign((found * white).sum(axis=0)), atol=1e-7)


def test_whitening_of_few_rows_and_dimensions(shipped):
    one = whitening.whitening_report(table(shipped, [[1.0, 2.0]])).collect()
    assert [(r["component"], r["whitened"], r["explained"], r["identity_error"]) for r in sorted(one)] == [(1, 0.0, 0.0, 0.0), (2, 0.0, 0.0, 0.0)]
    flat = [[float(k), 2.0 * k, 0.0] for k in range(20)] * 2  # of rank one, every row twice
    got = whitening.whitening_report(table(shipped, flat, ids=[k // 2 for k in range(40)])).collect()
    assert len(got) == 40 * 3 and all(r["whitened"] == 0 and r["explained"] == 0 for r in got if r["component"] > 1)
    first = [r["whitened"] for r in got if r["component"] == 1]
    assert math.isclose(sum(w * w for w in first) / 40, 1, rel_tol=1e-9) and got[0]["identity_error"] < 1e-9
    assert whitening.whitening_report(table(shipped, [None, []])).collect() == []
    assert whitening.whitening_report(table(shipped, [])).count() == 0


def test_whitening_of_extremes(shipped):
    vectors = [[1e15, 1.0], [-1e15, 2.0], [3e15, -1.0], [1e300, 0.0], [5.0, 5.0]]
    rows = table(shipped, [[0.0, 0.0]]).select("vec_id", F.col("embedding").cast("array<double>").alias("embedding")).limit(0).union(
        shipped.createDataFrame([(None if k == 4 else k, v) for k, v in enumerate(vectors)], "vec_id bigint, embedding array<double>")
    )
    got = whitening.whitening_report(rows).collect()
    assert len(got) == 8 and {r["n"] for r in got} == {4} and all(r["deviation"] is None for r in got)
    assert sum(r["vec_id"] is None for r in got) == 2 and all(math.isfinite(r["whitened"]) for r in got)


@pytest.mark.parametrize("size", [1, 2, 3, 40, 130])
def test_eigenvectors_against_numpy(size):
    rng = np.random.default_rng(size)
    x = rng.standard_normal((2 * size + 3, size)) * rng.uniform(0.1, 3, size)
    matrix = x.T @ x
    values, vectors = whitening.principal(matrix)
    want = np.linalg.eigvalsh(matrix)[::-1][:8]
    assert np.allclose(values, want, rtol=0, atol=1e-12 * want[0])
    assert np.allclose(vectors.T @ vectors, np.eye(len(values)), atol=1e-12)
    assert np.allclose(matrix @ vectors, vectors * values, atol=1e-12 * want[0])


def test_eigenvectors_of_clusters():
    """Equal and nearly equal eigenvalues: orthonormal all the same."""
    rng = np.random.default_rng(2)
    turn, _ = np.linalg.qr(rng.standard_normal((40, 40)))
    for spectrum in ([5.0] * 5 + [3.0] * 4 + [1.0] * 31, [1 + 1e-13 * k for k in range(40)], [1.0] * 40, [0.0] * 40, [7.0] + [0.0] * 39):
        matrix = turn @ np.diag(spectrum) @ turn.T
        matrix = (matrix + matrix.T) / 2
        values, vectors = whitening.principal(matrix)
        assert np.allclose(values, sorted(spectrum)[::-1][:8], atol=1e-12)
        assert np.allclose(vectors.T @ vectors, np.eye(8), atol=1e-12)
        assert np.allclose(matrix @ vectors, vectors * values, atol=1e-12)
