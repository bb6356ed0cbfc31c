"""SentencePiece encoding by suffix-array matching, and decoding.

For a model of the BPE kind with byte fallback, identity normalisation and a dummy prefix.
The distinct words that a batch adds are concatenated into one text. Its suffixes are
sorted by as many characters as the longest piece has (keys of four characters, doubled to
16), every piece is binary-searched for the range of suffixes it begins, and the ranges
are the edges of a lattice: a piece from its start to its end. Edges are sorted by the
position of their end and relaxed from left to right.

What is relaxed is BPE's own optimum, not a sum of scores: a sequence of pieces is what
merging gives exactly if each two neighbours are what merging gives for the two alone, and
every beginning of a word has one such sequence. So an edge takes over a position if its
start is reached by a piece that it may follow. Whether one piece may follow another comes
from the merges along their seam, and is kept.

Pieces never cross from one word to the next, so words are encoded once and kept by a
bounded cache in each Python worker; texts are then gathered from their words.

Cases. A null text has null ids, an empty one none. The character U+2581 stands for a
space in this vocabulary and decodes as one. Characters without a piece become the pieces
of their bytes. Repeated rows get equal results; empty tables give empty results.
"""

from __future__ import annotations

import functools
import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetgauge.llm.common import columns, field, map_bodies, quoted, unpacked

SPACE, LONGEST, CACHED, SLOTS = "▁", 16, 400_000, 1 << 21
#: Words whose lattice is built at once, and characters of the texts that are gathered at once.
WORDS, CHARACTERS = 1 << 15, 1 << 21


def merges(text: str, rank: dict[str, int]) -> tuple[list[str], tuple[str, str] | None]:
    """What merging gives for a text, best rank first, leftmost on ties; and the two parts of the last merge."""
    parts: list[str | None] = list(text)
    after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
    heap: list[tuple[int, int, str]] = []

    def offer(k):
        if k >= 0 and after[k] < len(parts) and (r := rank.get(parts[k] + parts[after[k]])) is not None:
            heapq.heappush(heap, (r, k, parts[k] + parts[after[k]]))

    for k in range(len(parts)):
        offer(k)
    last = None
    while heap:
        _, k, whole = heapq.heappop(heap)
        n = after[k] if parts[k] is not None else len(parts)
        if n == len(parts) or parts[n] is None or parts[k] + parts[n] != whole:
            continue
        last = parts[k], parts[n]
        parts[k], parts[n], after[k] = whole, None, after[n]
        if after[n] < len(parts):
            before[after[n]] = k
        offer(k)
        offer(before[k])
    return [p for p in parts if p is not None], last


def pack4(chars: np.ndarray) -> np.ndarray:
    """Four alphabet numbers (16 bits each) as one that sorts like them."""
    c = chars.astype(np.uint64)
    return c[:, 0] << np.uint64(48) | c[:, 1] << np.uint64(32) | c[:, 2] << np.uint64(16) | c[:, 3]


class Vocabulary:
    """A model's pieces, in order of rank: characters first, then merges."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        size = sp.get_piece_size()
        self.byte_ids = np.array([sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)], dtype=np.int32)
        ids = {sp.id_to_piece(i): i for i in range(size) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))}
        surfaces = [sp.id_to_piece(i).replace(SPACE, " ").encode() for i in range(size)]
        for b, i in enumerate(self.byte_ids):
            surfaces[i] = bytes([b])
        self.surface = np.frombuffer(b"".join(surfaces), dtype=np.uint8)
        self.surface_size = np.array([len(s) for s in surfaces])
        self.surface_start = np.cumsum(self.surface_size) - self.surface_size
        score = {p: -sp.get_score(i) for p, i in ids.items()}
        words = [p for p in ids if len(p) > 1 and SPACE not in p[1:]]
        if any(SPACE in p[1:] and p.strip(SPACE) for p in ids) or max(map(len, words)) > LONGEST:
            raise ValueError("pieces that hold a space inside, or are over 16 characters long, are not supported")
        self.runs = [run_pieces(n, {p: s for p, s in score.items() if not p.strip(SPACE)}) for n in range(LONGEST * 4 + 1)]
        self.run_ids = [[ids[p] for p in run] for run in self.runs]
        rank = {p: k for k, p in enumerate(sorted(words, key=lambda p: (score[p], ids[p])))}
        made = {p: merges(p, rank) for p in words}
        singles = sorted({c for p in ids for c in p})
        reached = [p for p in sorted(words, key=rank.get) if made[p][0] == [p]]
        self.names = singles + reached
        place = {p: k for k, p in enumerate(self.names)}
        # characters that are no piece of their own end as bytes; id -1 tells them
        self.ids = np.array([ids.get(p, -1) for p in self.names], dtype=np.int64)
        self.left = np.array([place.get(made[p][1][0], 0) if len(p) > 1 else k for k, p in enumerate(self.names)])
        self.right = np.array([place.get(made[p][1][1], 0) if len(p) > 1 else k for k, p in enumerate(self.names)])
        self.count = len(self.names) + 1  # one more for characters outside the alphabet
        pairs = sorted(
            (place[p[:k]] * self.count + place[p[k:]], place[p]) for p in reached for k in range(1, len(p)) if p[:k] in place and p[k:] in place
        )
        self.pair_codes = np.array([c for c, _ in pairs] or [-1])
        self.pair_ranks = np.array([r for _, r in pairs] or [-1])
        self.alphabet = np.zeros(0x110000, dtype=np.uint64)
        self.alphabet[:] = len(singles) + 1
        self.alphabet[[ord(c) for c in singles]] = np.arange(1, len(singles) + 1)
        chars = [[place[c] + 1 for c in p] for p in self.names]
        self.sizes = np.array([len(c) for c in chars])
        padded = np.zeros((len(chars), LONGEST), dtype=np.uint64)
        for k, c in enumerate(chars):
            padded[k, : len(c)] = c
        self.quads = pack4(padded.reshape(-1, 4)).reshape(-1, LONGEST // 4)  # lower ends, four characters each
        full = np.where(padded == 0, np.uint64(0xFFFF), padded)
        self.quads_high = pack4(full.reshape(-1, 4)).reshape(-1, LONGEST // 4)
        self.keys, self.valid = np.full(SLOTS, -1), np.zeros(SLOTS, dtype=bool)
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.flat, self.start, self.size = np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int64)

    def follows(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """Whether merging leaves two pieces next to each other as they are; from a table of bounded size where known."""
        codes = first * self.count + second
        slots = (codes * 0x9E3779B1 >> 7) % SLOTS
        miss = np.flatnonzero(self.keys[slots] != codes)
        found = self.valid[slots]
        if len(miss):
            some, place = np.unique(codes[miss], return_inverse=True)
            fresh = self.seam(some // self.count, some % self.count)
            found[miss] = fresh[place]
            self.keys[slots[miss]], self.valid[slots[miss]] = codes[miss], found[miss]
        return found

    def seam(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Undo the merges next to the seam, latest first: the pieces may stand together if no merge across it would have come before."""
        a, b = a.copy(), b.copy()
        outside = self.count - 1
        ok = np.ones(len(a), dtype=bool)
        going = np.flatnonzero((a != outside) & (b != outside))
        limit = np.full(len(a), np.iinfo(np.int64).max)
        while len(going):
            x, y = a[going], b[going]
            codes = x * self.count + y
            at = np.minimum(np.searchsorted(self.pair_codes, codes), len(self.pair_codes) - 1)
            across = (self.pair_codes[at] == codes) & (self.pair_ranks[at] < limit[going])
            ok[going[across]] = False
            base_x, base_y = self.right[x] == x, self.left[y] == y
            on_left = ~base_x & ((x > y) | base_y)
            limit[going] = np.where(on_left, x, y + 1)
            a[going] = np.where(on_left, self.right[x], x)
            b[going] = np.where(on_left, y, self.left[y])
            going = going[~across & ~(base_x & base_y)]
        return ok

    def edges(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and piece of every occurrence of a piece in a text of alphabet numbers."""
        n = len(text)
        padded = np.concatenate([text, np.zeros(LONGEST, np.uint64)])
        four = pack4(np.stack([padded[k : k + n] for k in range(4)], axis=1))
        seen4, rank4 = np.unique(four, return_inverse=True)
        u4 = len(seen4)
        later = lambda ranks, k, blank: np.concatenate([ranks[k:], np.full(min(k, n), blank)])
        eight = rank4 * u4 + later(rank4, 4, 0)
        seen8, rank8 = np.unique(eight, return_inverse=True)
        u8 = len(seen8)
        sixteen = rank8 * u8 + later(rank8, 8, 0)
        suffixes = np.argsort(sixteen, kind="stable")
        four, eight, sixteen = four[suffixes], eight[suffixes], sixteen[suffixes]
        # ranges of ranks that each quad of a piece covers, and its exact rank where the quad is full
        low = np.searchsorted(seen4, self.quads.reshape(-1)).reshape(self.quads.shape)
        high = np.searchsorted(seen4, self.quads_high.reshape(-1), "right").reshape(self.quads.shape)
        there = low < high
        pair = lambda k: (low[:, k] * u4 + low[:, k + 1], low[:, k] * u4 + high[:, k + 1])
        begin, end = np.zeros(len(self.sizes), np.int64), np.zeros(len(self.sizes), np.int64)
        s = self.sizes
        short = s <= 4
        begin[short], end[short] = np.searchsorted(four, self.quads[short, 0]), np.searchsorted(four, self.quads_high[short, 0], "right")
        mid = (s > 4) & (s <= 8) & there[:, 0]
        a, b = pair(0)
        begin[mid], end[mid] = np.searchsorted(eight, a[mid]), np.searchsorted(eight, b[mid])
        at8 = np.minimum(np.searchsorted(seen8, a), u8 - 1)
        long = (s > 8) & there[:, 0] & there[:, 1] & (seen8[at8] == a)
        c, d = pair(2)
        c, d = np.where(s <= 12, low[:, 2] * u4, c), np.where(s <= 12, high[:, 2] * u4, d)
        long &= there[:, 2]
        lo8, hi8 = np.searchsorted(seen8, c), np.searchsorted(seen8, d)
        begin[long] = np.searchsorted(sixteen, at8[long] * u8 + lo8[long])
        end[long] = np.searchsorted(sixteen, at8[long] * u8 + hi8[long])
        many = np.maximum(end - begin, 0)
        pieces = np.repeat(np.arange(len(s)), many)
        where = np.arange(len(pieces)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(begin, many)
        return suffixes[where], pieces

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Pieces of all words, one after the other, and how many each has."""
        sizes = np.array([len(w) for w in words])
        points = np.frombuffer("\0".join(words).encode("utf-32-le", "surrogatepass") + b"\0\0\0\0", dtype="<u4")
        text = self.alphabet[points]
        starts = np.cumsum(sizes + 1) - sizes - 1
        stops = starts + sizes
        text[stops] = 0
        start, piece = self.edges(text)
        outside = np.flatnonzero(text == len(self.alphabet_names()) + 1)
        start = np.concatenate([start, outside])
        piece = np.concatenate([piece, np.full(len(outside), self.count - 1)])
        length = np.concatenate([self.sizes, [1]])
        end = start + length[piece]
        word = np.searchsorted(starts, start, "right") - 1
        offset = end - starts[word]
        order = np.lexsort((-length[piece], offset))
        start, piece, end = start[order], piece[order], end[order]
        cuts = np.flatnonzero(np.diff(offset[order])) + 1
        last, back = np.full(len(text) + 1, -2), np.zeros(len(text) + 1, np.int64)
        last[starts] = -1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(order)]):
            before = last[start[a:b]]
            ok = before == -1
            reached = np.flatnonzero(before >= 0)
            ok[reached] = self.follows(before[reached], piece[a:b][reached])
            last[end[a:b][ok]], back[end[a:b][ok]] = piece[a:b][ok], start[a:b][ok]
        return self.trace(points, starts, stops, last, back)

    def alphabet_names(self) -> list[str]:
        return [p for p in self.names if len(p) == 1]

    def trace(self, points, starts, stops, last, back):
        """Walk all words back from their ends at once."""
        at, word = stops.copy(), np.arange(len(stops))
        going = np.flatnonzero(at > starts)
        words, pieces, places = [], [], []
        while len(going):
            p = last[at[going]]
            words.append(word[going]), pieces.append(p), places.append(back[at[going]])
            at[going] = back[at[going]]
            going = going[at[going] > starts[going]]
        if not words:
            return np.empty(0, np.int32), np.zeros(len(stops), np.int64)
        words, pieces, places = np.concatenate(words), np.concatenate(pieces), np.concatenate(places)
        order = np.argsort(places, kind="stable")
        words, pieces, places = words[order], pieces[order], places[order]
        ids = np.concatenate([self.ids, [-1]])[pieces]
        lost = np.flatnonzero(ids < 0)
        if len(lost):  # as bytes
            spelled = [self.byte_ids[list(chr(c).encode("utf-8", "surrogatepass"))] for c in points[places[lost]].tolist()]
            times = np.ones(len(ids), np.int64)
            times[lost] = [len(x) for x in spelled]
            words, ids = np.repeat(words, times), np.repeat(ids, times)
            ids[ids < 0] = np.concatenate(spelled)
        return ids.astype(np.int32), np.bincount(words, minlength=len(stops))

    def learn(self, parts: set[str]) -> None:
        """Encode the parts that are not known yet; a part that begins with a line end has no space before it."""
        fresh = [p for p in parts if p and p not in self.known]
        if len(self.known) + len(fresh) > CACHED and self.known:
            self.forget()
            fresh = [p for p in parts if p]
        for k in range(0, len(fresh), WORDS):
            some = fresh[k : k + WORDS]
            flat, size = self.encode_words([p if p[0] == "\n" else SPACE + p for p in some])
            base = len(self.known)
            self.known.update(zip(some, range(base, base + len(some))))
            self.start = np.concatenate([self.start, len(self.flat) + np.cumsum(size) - size])
            self.size = np.concatenate([self.size, size])
            self.flat = np.concatenate([self.flat, flat])

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text, some texts at a time."""
        out, some, held = [], [], 0
        for text in texts:
            some.append(text)
            held += len(text)
            if held > CHARACTERS:
                out += self.encode_some(some)
                some, held = [], 0
        return out + self.encode_some(some)

    def encode_some(self, texts: list[str]) -> list[np.ndarray]:
        parts = [text.replace(SPACE, " ").replace("\n", " \n").split(" ") if text else [] for text in texts]
        self.learn(set().union(*parts))
        out = []
        for own in parts:
            if "" in own:
                out.append(self.spaced(own))
                continue
            words = np.fromiter(map(self.known.__getitem__, own), np.int64, len(own))
            size = self.size[words]
            at = np.repeat(self.start[words] - (np.cumsum(size) - size), size) + np.arange(size.sum())
            out.append(self.flat[at])
        return out

    def spaced(self, parts: list[str]) -> np.ndarray:
        """A text with more than one space in a row: what words leave of the spaces is merged last."""
        out, run = [], 0
        blank = self.run_ids[1][0]
        for part in [*parts, None]:
            if part == "":
                run += 1
                continue
            ids = [] if part is None else self.flat[(s := self.start[self.known[part]]) : s + self.size[self.known[part]]].tolist()
            if part and part[0] != "\n" and ids[0] == blank:
                run, ids = run + 1, ids[1:]
            out += self.run_of(run) + ids
            run = 0
        return np.array(out, dtype=np.int32)

    def run_of(self, n: int) -> list[int]:
        """Pieces of n spaces in a row: as many of the longest as fit, then the rest."""
        if n < len(self.run_ids):
            return self.run_ids[n]
        widest = self.run_ids[-1][0]
        step = self.surface_size[widest]
        whole = (n - len(self.run_ids) + 1 + step - 1) // step
        return [widest] * int(whole) + self.run_ids[n - int(whole * step)]

    def decode(self, ids: np.ndarray) -> bytes:
        """UTF-8 bytes of the pieces, without the space put in front."""
        size = self.surface_size[ids]
        at = np.repeat(self.surface_start[ids] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        out = self.surface[at].tobytes()
        return out[1:] if out[:1] == b" " else out


def run_pieces(n: int, score: dict[str, float]) -> list[str]:
    """Merging n spaces: equal scores, so the leftmost pair each time."""
    order = {s: k for k, s in enumerate(sorted(set(score.values())))}
    return merges(SPACE * n, {p: order[s] for p, s in score.items() if len(p) > 1})[0]


@functools.cache
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


IDS = T.ArrayType(T.IntegerType())


def plain(body: bytes | None) -> str:
    return (body or b"").decode("utf-8", "replace")


def listed(arrays: list, bodies: list) -> pa.Array:
    sizes = np.array([0, *(len(a) for a in arrays)])
    flat = np.concatenate(arrays) if arrays else np.empty(0, np.int32)
    lists = pa.ListArray.from_arrays(pa.array(np.cumsum(sizes), pa.int32()), pa.array(flat, pa.int32()))
    return pa.compute.if_else(pa.array([b is not None for b in bodies]), lists, pa.scalar(None, lists.type))


def encoded(docs: DataFrame, model: str, carry: list[str] | None = None, text: str = "text", check: bool = False) -> DataFrame:
    """`row`, `ids` and, if asked for, whether they decode to the text (U+2581 counts as a space)."""
    import pyarrow.compute  # noqa: F401

    def work(bodies):
        words = vocabulary(model)
        out = words.encode([plain(b) for b in bodies])
        made = [listed(out, bodies)]
        if check:
            space = SPACE.encode()
            made.append([None if b is None else words.decode(ids) == b.replace(space, b" ") for b, ids in zip(bodies, out)])
        return made

    return map_bodies(docs, work, [field("ids", IDS), *[field("round_trip", "boolean")] * check], carry, text)


def decoded(rows: DataFrame, model: str, ids: str = "ids", carry: list[str] | None = None) -> DataFrame:
    """`row` and the `decoded` text of a column of ids."""
    names = carry or [c for c in rows.columns if c != ids]
    source = rows.select(F.struct(*columns(rows, names)).alias("row"), F.col(quoted(ids)).cast("array<int>").alias("ids"))
    schema = T.StructType([source.schema["row"], field("decoded", "string")])

    def run(batches):
        for batch in batches:
            words = vocabulary(model)
            out = [None if x is None else words.decode(np.array(x, np.int64)).decode("utf-8", "replace") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=["row", "decoded"])

    return source.mapInArrow(run, schema)


def pieces_report(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, n_ids, ids, round_trip."""
    rows = encoded(docs, model, ["doc_id"], check=True)
    return unpacked(rows, F.size("ids").cast("bigint").alias("n_ids"), "ids", "round_trip")
