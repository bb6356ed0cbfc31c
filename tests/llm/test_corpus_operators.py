"""SimHash, line dedup, packing, sharding and neighbours against plain versions."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from hard_rows import HARD
from pyspark.sql import types as T

from fleetgauge.llm import ann, line_dedup, near_copies, packing, sharding, simhash
from fleetgauge.llm.components import components
from fleetgauge.llm.registry import tokenizer

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
PROSE = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen".split()


def plain_fingerprint(text):
    words = WORDS.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    if not words:
        return 0
    shingles = [words[k : k + 3] for k in range(len(words) - 2)] or [words]
    hashes = [xxhash.xxh64_intdigest(" ".join(s).encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(links, nodes):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {n: find(n) for n in nodes}


def plain_simhash(rows):
    fps = [(i, plain_fingerprint(t)) for i, t in rows]
    distinct = sorted({f for _, f in fps})
    links = [(a, b) for k, a in enumerate(distinct) for b in distinct[k + 1 :] if (a ^ b).bit_count() <= 2]
    root = plain_components(links, distinct)
    low = {}
    for i, f in fps:
        if i is not None:
            low[root[f]] = min(low.get(root[f], i), i)
    return sorted([(i, f"{f:016x}", low.get(root[f])) for i, f in fps], key=repr)


def near_texts(seed=3):
    dice = random.Random(seed)
    out = []
    for _ in range(12):
        words = [dice.choice(PROSE) + dice.choice("abcdef") for _ in range(300)]
        for _ in range(6):
            out.append(" ".join(words))
            words[dice.randrange(300)] = "changed"
    return out


def test_simhash_against_plain(documents, small):
    _, rows = small
    texts = [(r["doc_id"], r["text"]) for r in rows] + HARD + [(3000 + k, t) for k, t in enumerate(near_texts())]
    got = simhash.simhash_report(documents(*texts)).collect()
    assert sorted([tuple(r) for r in got], key=repr) == plain_simhash(texts)


@pytest.mark.parametrize("crowd", [0, 3, 64])
def test_links_connect_what_brute_force_connects(shipped, monkeypatch, crowd):
    monkeypatch.setattr(simhash, "CROWD", crowd)
    dice = random.Random(crowd)
    fps = {dice.getrandbits(64) for _ in range(150)}
    for f in list(fps)[:40]:
        for _ in range(12):
            f ^= 1 << dice.randrange(64)
            f ^= 1 << dice.randrange(64)
            fps.add(f)
    center = dice.getrandbits(64)
    fps |= {center ^ 1 << a ^ 1 << b for a in range(30) for b in range(30)}
    signed = sorted(map(simhash.signed, fps))
    pairs = simhash.links(shipped.createDataFrame([(f,) for f in signed], "fp bigint")).collect()
    mask = (1 << 64) - 1
    assert all(((r["left"] ^ r["right"]) & mask).bit_count() <= 2 and r["left"] < r["right"] for r in pairs)
    want = [(a, b) for k, a in enumerate(signed) for b in signed[k + 1 :] if ((a ^ b) & mask).bit_count() <= 2]
    assert plain_components([(r["left"], r["right"]) for r in pairs], signed) == plain_components(want, signed)


@pytest.mark.parametrize("crowd", [0, 64])
def test_replicas_are_not_broadcast(shipped, monkeypatch, capsys, tmp_path, crowd):
    """Spark takes them for as few as the fingerprints that they are made of, here a table of known size."""
    monkeypatch.setattr(simhash, "CROWD", crowd)
    dice = random.Random(5)
    fps = [simhash.signed(dice.getrandbits(64)) for _ in range(50)]
    shipped.createDataFrame([(f,) for f in [*fps, *(f ^ 1 for f in fps)]], "fp bigint").write.parquet(f"{tmp_path}/fps")
    found = simhash.links(shipped.read.parquet(f"{tmp_path}/fps"))
    found.explain()
    plan = capsys.readouterr().out
    assert "MapInArrow" in plan
    assert not re.search(r"BroadcastHashJoin.*Inner", plan)
    assert {(r["left"], r["right"]) for r in found.collect()} == {(min(f, f ^ 1), max(f, f ^ 1)) for f in fps}


def test_every_pair_within_two_bits_meets_at_a_home():
    dice = random.Random(9)
    for _ in range(60):
        x = dice.getrandbits(64)
        y = x ^ (1 << dice.randrange(64)) ^ (1 << dice.randrange(64))
        rows, anchors, home = simhash.anchors_of(np.array([simhash.signed(x), simhash.signed(y)]))
        of = lambda r, h: {int(a) for k, a, b in zip(rows, anchors, home) if k == r and (b or not h)}
        assert len(of(0, True)) == len(of(1, True)) == 1
        assert of(0, True) <= of(1, False) and of(1, True) <= of(0, False)


def test_components_of_paths_and_stars(shipped):
    edges = [(k, k + 1) for k in range(40)] + [(100, 100 + k) for k in range(1, 60)] + [(7, 7), (None, 3), (200, 201), (201, 200)]
    got = components(shipped.createDataFrame(edges, "a bigint, b bigint"), "a", "b").collect()
    want = plain_components([e for e in edges if None not in e], {n for e in edges for n in e if n is not None})
    assert {r["node"]: r["root"] for r in got} == want and len(got) == len(want)


def test_one_of_each(documents):
    texts = near_texts()
    a, b = next((a, b) for a, b in zip(texts, texts[1:]) if (plain_fingerprint(a) ^ plain_fingerprint(b)).bit_count() <= 2)
    docs = documents((5, a), (4, b), (4, b), (None, a), (9, "alone in this table"), (None, None), (7, ""), clash=("component", "row", "fp"))
    out = simhash.one_of_each(docs)
    assert out.schema == docs.schema
    assert sorted((r["doc_id"] or -1, r["text"]) for r in out.collect()) == [(4, b), (7, ""), (9, "alone in this table")]


def test_one_of_each_catches_near_copies(documents):
    """Copies of 0.8 to 0.95, most of them far over two bits apart, against brute force over the sets."""
    dice = random.Random(6)
    texts, near = [], 0
    for k in range(60):
        words = [f"w{dice.randrange(5000)}" for _ in range(dice.choice([100, 300, 1000]))]
        other = list(words)
        while jaccard(words, other) > 0.8 + 0.15 * (k + 1) / 61:
            before, at = list(other), dice.randrange(len(other))
            other[at] = f"new{at}"
        other = other if jaccard(words, other) >= 0.8 else before
        near += (plain_fingerprint(" ".join(words)) ^ plain_fingerprint(" ".join(other))).bit_count() <= 2
        texts += [words, other]
    assert near < 30
    links = [(a, b) for b in range(len(texts)) for a in range(b) if jaccard(texts[a], texts[b]) >= 0.8]
    root = plain_components(links, range(len(texts)))
    assert len(links) >= 60
    got = simhash.one_of_each(documents(*[(k, " ".join(w)) for k, w in enumerate(texts)])).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(set(root.values()))


@pytest.mark.parametrize("own", [60, 27, 9])
def test_pairs_tried_follow_the_documents(documents, monkeypatch, own):
    """Pages of one template: far from each other, just below the similarity, and near copies. Pairs tried grow with the pages, not their square."""
    counts, verified = [], near_copies.verified

    def counted(pairs, sets):
        counts.append(pairs.count())
        return verified(pairs, sets)

    monkeypatch.setattr(near_copies, "verified", counted)
    dice, template, n = random.Random(own), [f"t{k}" for k in range(200 - own)], 600
    pages = [template + [f"p{k}x{j}" for j in range(own)] for k in range(n)]
    similarity = jaccard(pages[0], pages[1])
    dice.shuffle(pages)
    got = simhash.one_of_each(documents(*[(k, " ".join(p)) for k, p in enumerate(pages)])).count()
    assert got == (1 if similarity >= 0.8 else n)
    assert sum(counts) <= 3 * n


def test_near_copies_meet_at_anchors(documents, monkeypatch):
    """Copies whose fingerprints lie within two bits are found by the anchors alone."""
    monkeypatch.setattr(near_copies, "prefixes", lambda sets, last: PREFIXES(sets, last).where("false"))
    words = [f"w{k}" for k in range(2000)]
    pages = [words, [*words[:-1], "end"], [*words[:-1], "other"], [f"x{k}" for k in range(2000)], ["few", "words"], []]
    calls, links = [], simhash.links

    def met(distinct):
        calls.append(distinct)
        return links(distinct)

    monkeypatch.setattr(simhash, "links", met)
    got = simhash.one_of_each(documents(*[(k, " ".join(p)) for k, p in enumerate(pages)])).collect()
    assert sorted(r["doc_id"] for r in got) == [0, 3, 4, 5] and len(calls) == 1


PREFIXES = near_copies.prefixes


def jaccard(a, b):
    a, b = ({tuple(x[k : k + 5]) for k in range(len(x) - 4)} for x in (a, b))
    return len(a & b) / len(a | b)


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j - 1] + (x != y), row[j] + 1, new[-1] + 1))
        row = new
    return row[-1]


def plain_lines(rows, edits=1):
    """Numbers of the lines to drop, by comparing every line with every earlier one: by words from eight on, else by characters."""
    lines = []
    for i, text in sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0, signed_key(r[1]))):
        for no, line in enumerate((text or "").split("\n")):
            words = re.findall(r"[^\x20\x09-\x0D]+", line)
            if words:
                lines.append((i, text, no, words if len(words) >= 8 else " ".join(words)))

    def close(a, b):
        if a == b:
            return True
        if type(a) is not type(b):
            return False
        most = min(edits, min(len(a), len(b)) // (16 if isinstance(a, str) else 8))
        if most == 0 or abs(len(a) - len(b)) > most:
            return False
        if most > 1:
            return edit_distance(a, b) <= most
        k = next(k for k in range(len(a) + 1) if a[k : k + 1] != b[k : k + 1])  # one unit replaced, left out or put in
        return a[k + 1 :] == b[k + 1 :] or a[k + 1 :] == b[k:] or a[k:] == b[k + 1 :]

    drop, earlier = defaultdict(list), []
    for i, text, no, line in lines:
        if any(close(line, other) for other in earlier):
            drop[i, text].append(no)
        if line not in earlier:
            earlier.append(line)
    return [(i, 0 if t is None else t.count("\n") + 1, ",".join(map(str, drop[i, t]))) for i, t in rows]


def signed_key(text):
    key = 42 if text is None else xxhash.xxh64_intdigest(text.encode(), 42)
    return simhash.signed(key)


def line_rows():
    dice = random.Random(4)
    base = [[dice.choice(PROSE) for _ in range(n)] for n in (3, 5, 8, 9, 12, 40, 200)]
    rows = [(0, "\n".join(" ".join(w) for w in base))]
    for i in range(1, 30):
        lines = [f"Read the whole of chapter {dice.randrange(30)}", dice.choice(["see bel0w, page 1", "see below, page 1", "see below page 1"]), f"p. {i}"]
        for w in base:
            w, kind = list(w), dice.randrange(6)
            k = dice.randrange(len(w))
            if kind == 1:
                w[k] = dice.choice(PROSE)
            elif kind == 2:
                del w[k]
            elif kind == 3:
                w.insert(k, dice.choice(PROSE))
            elif kind == 4:
                w[k], w[0] = "new", "newer"
            lines.append(("\t" if kind == 5 else " ").join(w))
        rows.append((i, "\n".join([*lines, "", "*", "a b"])))
    return rows


def test_line_dedup_against_plain(documents):
    rows = line_rows() + HARD
    got = line_dedup.line_report(documents(*rows)).select("doc_id", "n_lines", "removed").collect()
    assert sorted(map(tuple, got), key=repr) == sorted(plain_lines(rows), key=repr)


@pytest.mark.parametrize("edits", [2, 3])
def test_line_dedup_with_more_edits(documents, edits):
    dice = random.Random(edits)
    rows = []
    for i in range(25):
        lines = []
        for n in (9, 16, 17, 26):
            w = [PROSE[k % len(PROSE)] for k in range(n)]
            for _ in range(dice.randrange(4)):
                k, kind = dice.randrange(len(w)), dice.randrange(3)
                w[k : k + (kind != 1)] = [] if kind == 0 else [dice.choice(["x", "y"])]
            lines.append(" ".join(w))
        short = list("a short line that has some 50 characters or so")[: 30 + 16 * dice.randrange(2)]
        for _ in range(dice.randrange(4)):
            short[dice.randrange(len(short))] = dice.choice("xyz")
        rows.append((i, "\n".join([*lines, "".join(short).replace(" ", "-", 3)])))
    got = line_dedup.repeats(documents(*rows), edits=edits).collect()
    want = {i: removed for i, _, removed in plain_lines(rows, edits)}
    assert {r["id"]: ",".join(map(str, sorted(r["removed"]))) for r in got} == want
    assert any(want.values()) and want != {i: removed for i, _, removed in plain_lines(rows, 1)}


def test_edit_bounds():
    with pytest.raises(ValueError, match="edit bound"):
        line_dedup.repeats(None, edits=4)
    dice = random.Random(1)
    for _ in range(3000):
        a = "".join(dice.choices("ab", k=dice.randrange(14, 52)))
        b = list(a)
        for _ in range(dice.randrange(5)):
            k = dice.randrange(len(b))
            b[k : k + dice.randrange(2)] = dice.choices("ab", k=dice.randrange(2))
        b = "".join(b)
        most = min(3, min(len(a), len(b)) // 16)
        assert line_dedup.within(a, b, 3) == (edit_distance(a, b) <= most)


def test_line_dedup_on_documents(documents, small):
    _, rows = small
    texts = [(r["doc_id"], r["text"]) for r in rows]
    got = line_dedup.line_report(documents(*texts)).select("doc_id", "n_lines", "removed").collect()
    assert sorted(map(tuple, got)) == sorted(plain_lines(texts))


def test_short_lines_go_as_exact_repeats(documents):
    got = line_dedup.line_report(documents((1, "one\na b\n\n \na c"), (2, "a  b\none\ntwo\n\n "))).collect()
    assert {r["doc_id"]: r["removed"] for r in got} == {1: "", 2: "0,1"}


def test_line_dedup_texts(documents):
    rows = line_rows() + HARD
    docs = documents(*rows, clash=("removed", "body", "kept", "own"))
    out = line_dedup.deduplicated(docs)
    assert out.schema == docs.schema
    want = Counter()
    for (i, text), (_, _, drop) in zip(rows, plain_lines(rows)):
        gone = {int(n) for n in drop.split(",") if n}
        want[i, None if text is None else "\n".join(x for k, x in enumerate(text.split("\n")) if k not in gone)] += 1
    assert Counter((r["doc_id"], r["text"]) for r in out.collect()) == want


def ids_of(text):
    from tokenizers import Tokenizer

    return [*Tokenizer.from_file(tokenizer()).encode(text or "", add_special_tokens=False).ids, 0]


def test_packing_ids_and_places(documents, small):
    _, rows = small
    texts = [(r["doc_id"], r["text"]) for r in rows] + [(5000 + k, t) for k, (_, t) in enumerate(HARD)] + [(6000, "a<|endoftext|>b"), (6001, "x"), (6001, "x")]
    got = packing.packing_report(documents(*texts), tokenizer()).collect()
    want = Counter()
    for i, text in texts:
        ids = ids_of(text)
        for k, (s, n) in enumerate(packing.cut(len(ids))):
            want[i, k, s, n, zlib.crc32(np.array(ids[s : s + n], "<u4"))] += 1
    assert Counter(tuple(r)[:5] for r in got) == want
    by_sequence = defaultdict(list)
    for r in got:
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= packing.SEQUENCE
    assert len(by_sequence) <= -(-sum(n for *_, n, _ in want.elements()) // packing.SEQUENCE) * 1.1 + 1


@pytest.mark.parametrize("length", [1, 2, 2047, 2048, 2049, 4096, 5000])
def test_cut(length):
    pieces = packing.cut(length)
    assert [s for s, _ in pieces] == [sum(n for _, n in pieces[:k]) for k in range(len(pieces))]
    assert sum(n for _, n in pieces) == length and all(n == packing.SEQUENCE for _, n in pieces[1:])
    assert len(pieces) == -(-length // packing.SEQUENCE)


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_best_fit_holds_every_capacity(rule):
    lengths = np.sort(np.random.default_rng(2).integers(1, 1000, 500))[::-1]
    sequence, offset = packing.best_fit(lengths, size=1000, documents=3, attention=600_000.0 * 2, rule=rule, preferred_documents=2)
    for s in set(sequence.tolist()):
        own = lengths[sequence == s]
        assert own.sum() <= 1000 and len(own) <= 3 and (own.astype(float) ** 2).sum() <= 1_200_000
        assert sorted(offset[sequence == s].tolist()) == sorted(np.cumsum(own) - own)
    with pytest.raises(ValueError):
        packing.best_fit(np.array([900]), size=1000, attention=10.0)


def test_every_capacity_acts_and_costs_no_sequence():
    """Lifting a preferred capacity changes where pieces go; none of them opens a sequence."""
    dice = np.random.default_rng(4)
    lengths = np.sort(np.concatenate([dice.integers(1, 300, 2500), dice.integers(300, 2049, 1500)]))[::-1]
    both, _ = packing.best_fit(lengths)
    lifted = [packing.best_fit(lengths, preferred_documents=2048)[0], packing.best_fit(lengths, preferred_attention=1.0)[0]]
    free, _ = packing.best_fit(lengths, preferred_documents=2048, preferred_attention=1.0)
    assert all((x != both).any() for x in lifted) and (lifted[0] != lifted[1]).any()
    assert len(set(both.tolist())) <= len(set(free.tolist())) + 1

    def worst(sequence):
        documents = np.bincount(sequence)
        cost = np.bincount(sequence, weights=lengths.astype(float) ** 2)[documents > 1] / 2048**2
        return (documents > packing.DOCUMENTS).sum(), (cost > packing.ATTENTION).sum()

    assert worst(both)[0] <= worst(free)[0] and worst(both)[1] <= worst(free)[1]


def test_best_fit_is_close_to_the_bound():
    lengths = np.sort(np.random.default_rng(3).integers(1, 2049, 4000))[::-1]
    sequence, _ = packing.best_fit(lengths)
    assert len(set(sequence.tolist())) <= 1.02 * -(-lengths.sum() // 2048)


def test_unicode_splits_as_the_library_does():
    """The two libraries split texts by regular expressions of their own."""
    from tokenizers import Tokenizer

    slow, fast = Tokenizer.from_file(tokenizer()), packing.encoder(tokenizer())
    texts = [f"a{c} {c}1{c}'s {c}{c}\n{c}" for c in map(chr, range(0x3000)) if not 0xD800 <= ord(c) < 0xE000]
    texts += [f"a{chr(c)} {chr(c)}1" for c in range(0x3000, 0x20000, 7) if not 0xD800 <= c < 0xE000]
    want = [e.ids for e in slow.encode_batch(texts, add_special_tokens=False)]
    assert [fast.encode(t, allowed_special="all") for t in texts] == want


def check_shards(rows, got):
    n = len(rows)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter(
        (i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows
    )
    counts = Counter(r["shard"] for r in got)
    assert set(counts) <= set(range(16)) and max(counts.values(), default=0) - min([counts[k] for k in range(16)]) <= 1 and sum(counts.values()) == n
    for k in counts:
        assert sorted(r["slot"] for r in got if r["shard"] == k) == list(range(counts[k]))
    assert {(r["law"], r["grown_shard"]) for r in got} <= {("rows", None)}


@pytest.mark.parametrize("n", [0, 1, 5, 16, 17, 200])
def test_sharding_is_even(documents, n):
    rows = [(k % 150, f"text {k % 40}\n" + "a line that is long enough to be linked by it " * (k % 3)) for k in range(n)]
    check_shards(rows, sharding.sharding_report(documents(*rows)).collect())


def test_sharding_keeps_copies_together(documents, small):
    _, rows = small
    texts = [(r["doc_id"], r["text"]) for r in rows] + HARD + [(9000 + k, f"{k % 60}: copies of a text, three of each of them here") for k in range(180)]
    got = sharding.sharding_report(documents(*texts)).collect()
    check_shards(texts, got)
    shards = defaultdict(set)
    for r in got:
        if r["doc_id"] and r["doc_id"] >= 9000:
            shards[(r["doc_id"] - 9000) % 60].add(r["shard"])
    assert sum(len(s) > 1 for s in shards.values()) <= 15


def test_rows_repeated_in_number_part(documents, monkeypatch):
    """A row that repeats whole many times is placed row by row, and no cell or group holds all of them."""
    monkeypatch.setattr(sharding, "CELL", 16)
    monkeypatch.setattr(sharding, "HOT", 8)
    rows = [(7, "the same row\nwith a line")] * 500 + [(k, f"text {k}\nwith a line") for k in range(100, 300)]
    check_shards(rows, sharding.sharding_report(documents(*rows)).collect())
    pieces = packing.tokenized(documents(*rows), tokenizer(), ["doc_id"]).selectExpr("row", "inline(pieces)")
    packed = packing.pack(pieces, group=50).collect()
    assert Counter(r["row"]["doc_id"] for r in packed)[7] == 500
    groups = {r["sequence_id"] >> 32 for r in packed if r["row"]["doc_id"] == 7}
    assert len(groups) >= 8


def test_label_propagation_joins_neighbours(shipped):
    """Two bipartite clusters with mixed labels come to agree, within capacity."""
    nodes = shipped.createDataFrame([(k, 1, k) for k in range(400)], "node bigint, weight bigint, first bigint")
    edges = shipped.createDataFrame([(k, 1, k // 10, k) for k in range(400)], "node bigint, weight bigint, hub bigint, first bigint").select("node", "hub")
    spread = lambda rows: sum(len({r["label"] for r in rows if r["node"] // 10 == h}) - 1 for h in range(40))
    before = sharding.propagate(nodes, edges, 4, 0).collect()
    after = sharding.propagate(nodes, edges, 4, 6).collect()
    assert spread(after) < spread(before) / 2
    loads = Counter(r["label"] for r in after)
    assert max(loads.values()) <= max(Counter(r["label"] for r in before).values())


def test_any_shared_line_links(documents):
    """Pairs share one line, long or short, among many of their own."""
    own = lambda k: [f"{n} line of document {k} that no other document has, number {n}" for n in range(30)]
    rows = [(k, "\n".join([*own(k)[:15], f"shared {k // 2}" if k % 4 < 2 else f"one longer line that the documents of pair {k // 2} share", *own(k)[15:]])) for k in range(240)]
    got = {r["doc_id"]: r["label"] for r in sharding.sharding_report(documents(*rows)).collect()}
    assert sum(got[k] == got[k + 1] for k in range(0, 240, 2)) == 120


VECTORS = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("label", T.IntegerType())])


def plain_neighbours(rows, k=10):
    good = [(i, np.array(v, np.float32).astype(float)) for i, v in rows if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {}
    for i, v in good:
        if i is not None and i % 100 == 0:
            far = sorted((float(np.sqrt(((w - v) ** 2).sum())), j) for j, w in good if j != i and len(w) == len(v))
            out[i] = far[:k]
    return out


def vectors(n=700, size=16, seed=1):
    rng = np.random.default_rng(seed)
    rows = [(k, [float(np.float32(x)) for x in rng.standard_normal(size)]) for k in range(n)]
    rows += [(n + k, rows[100][1]) for k in range(30)]  # copies
    rows += [(2000, None), (2100, []), (2200, [0.0] * size), (2300, [float("nan")] * size), (2400, [1.0] * (size - 1) + [None]), (2500, [float("inf")] * size)]
    rows += [(2600, [1.0, 2.0]), (2601, [1.0, 2.5])]
    return rows


def test_neighbours_against_plain(shipped):
    rows = vectors()
    table = shipped.createDataFrame([(i, v, None) for i, v in rows], VECTORS).repartition(3)
    got = defaultdict(list)
    for r in ann.ann_report(table).orderBy("query_id", "rank").collect():
        assert r["rank"] == len(got[r["query_id"]]) + 1
        got[r["query_id"]].append((r["score"], r["vec_id"]))
    want = plain_neighbours(rows)
    assert set(got) == set(want)
    hits = sum(len({j for _, j in got[i]} & {j for _, j in w}) for i, w in want.items())
    assert hits >= 0.95 * sum(map(len, want.values()))
    assert got[100] == want[100] and [j for _, j in got[100]] == [700 + k for k in range(10)]
    exact = {(i, j): s for i, v in rows for j, w in rows if i in want and v and w and len(v) == len(w) and None not in v and None not in w
             for s in [float(np.sqrt(((np.array(v) - np.array(w)) ** 2).sum()))]}
    assert all(s == exact[i, j] and got[i] == sorted(got[i]) for i, x in got.items() for s, j in x)


def test_repeated_and_null_ids(shipped):
    """Only the query's own row is left out: its copies and other rows with its id are candidates."""
    rows = [(100, [0.0, 1.0]), (100, [0.0, 1.0]), (None, [0.0, 1.1]), (7, [0.0, 2.0]), (7, [0.0, 2.0]), (100, [5.0, 5.0])]
    table = shipped.createDataFrame([(i, v, None) for i, v in rows], VECTORS)
    found = ann.ann_report(table).collect()
    near = sorted((r["rank"], r["vec_id"], round(r["score"], 3)) for r in found if r["score"] < 1.5)
    assert near == [(1, 100, 0.0), (2, None, 0.1), (3, 7, 1.0), (4, 7, 1.0)]
    assert sorted((r["vec_id"] or 0, round(r["score"], 3)) for r in found if r["score"] > 1.5) == [(0, 6.341), (7, 5.831), (7, 5.831), (100, 6.403), (100, 6.403), (100, 6.403)]


def test_largest_ids_and_vectors_repeated_in_number(shipped):
    most = (1 << 63) - 1
    rows = [(most, [1.0, 1.0]), (100, [1.0, 1.5])] + [(3, [1.0, 2.0])] * 400 + [(None, [1.0, 1.5])]
    table = shipped.createDataFrame([(i, v, None) for i, v in rows], VECTORS)
    got = [(r["vec_id"], r["score"]) for r in ann.ann_report(table).orderBy("rank").collect()]
    assert got == [(None, 0.0)] + [(3, 0.5)] * 9
    got = {r["vec_id"] for r in ann.neighbours(table, table.where("vec_id = 100"), 500).collect()}
    assert got == {None, 3, most}


@pytest.mark.parametrize("scale", [1e308, 1e-308, 5e153])
def test_extreme_vectors_end(shipped, scale):
    """Finite vectors whose squares, differences or projections leave the range of doubles."""
    rng = np.random.default_rng(3)
    rows = [(k, [float(x) for x in rng.uniform(-1, 1, 4) * (scale if k % 2 else 1.0)]) for k in range(205)]
    table = shipped.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = defaultdict(list)
    for r in ann.ann_report(table).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["score"], r["vec_id"]))
    assert set(got) == {0, 100, 200} and all(len(x) == 10 and x == sorted(x) for x in got.values())
    hits = 0
    for i, x in got.items():
        with np.errstate(all="ignore"):
            far = sorted((float(np.linalg.norm(np.array(v, np.longdouble) - np.array(rows[i][1], np.longdouble))), j) for j, v in rows if j != i)
        hits += len({j for _, j in x} & {j for _, j in far[:10]})
    assert hits >= 27


def test_neighbours_over_several_blocks(shipped, monkeypatch):
    rows = [(k, v) for k, v in vectors(900) if k < 900]
    monkeypatch.setattr(ann, "BLOCK", 200)
    monkeypatch.setattr(ann, "LEAST", 100)
    table = shipped.createDataFrame([(i, v, None) for i, v in rows], VECTORS)
    got = defaultdict(list)
    for r in ann.ann_report(table).collect():
        got[r["query_id"]].append((r["score"], r["vec_id"]))
    want = plain_neighbours(rows)
    assert {i: len(x) for i, x in got.items()} == {i: 10 for i in want}
    assert sum(len({j for _, j in got[i]} & {j for _, j in w}) for i, w in want.items()) >= 0.95 * 10 * len(want)


def test_recall_on_embeddings(shipped):
    table = shipped.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"]) for r in table.collect()]
    want = plain_neighbours(rows)
    got = defaultdict(set)
    for r in ann.ann_report(table).collect():
        got[r["query_id"]].add(r["vec_id"])
    assert sum(len(got[i] & {j for _, j in w}) for i, w in want.items()) >= 0.95 * sum(map(len, want.values()))


@pytest.mark.parametrize("report", [
    simhash.simhash_report, simhash.one_of_each, line_dedup.line_report, line_dedup.deduplicated,
    lambda d: packing.packing_report(d, tokenizer()), sharding.sharding_report,
])
def test_empty_table(documents, report):
    assert report(documents()).collect() == []


def test_no_vectors(shipped):
    assert ann.ann_report(shipped.createDataFrame([], VECTORS)).collect() == []
