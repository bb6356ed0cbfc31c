"""License scans: exact phrases and short notices within a bounded number of edits.

A notice of n characters may differ in up to e = max_edits(n) characters. Split into e + 1
pieces, at least one piece of any match is unchanged (pigeonhole), so the pieces are exact
seeds: a plain byte search for them finds every candidate place. Around each hit a window
of the notice's length plus the edits goes to the regex library's bounded-error matching,
which verifies the edits and gives the span. Windows that touch are joined and cut again
to a few lengths of the notice, so that the work follows the text's length.

Texts are compared as words: A-Z in lower case, words are runs of digits, letters and
non-ASCII characters, one space between them.

Cases. Null and empty texts have no words and no notice: labels are empty, score 0. Ties
between spans go to fewer edits, then to the earlier span. Equal rows give equal results,
empty tables empty ones.
"""

from __future__ import annotations

import functools
import re
from bisect import bisect_right

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetgauge.llm.common import field, map_bodies, strings, structs, unpacked

#: Phrases whose exact places are counted, with their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Short notices that are searched with errors, and the labels that they add.
NOTICES = {
    "released under the mit license": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "licensed under the apache license version 2 0": "apache-2.0",
    "licensed under the gnu general public license version 3": "gpl-3.0",
    "licensed under the gnu general public license version 2": "gpl-2.0",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license version 2 0": "mpl-2.0",
    "redistribution and use in source and binary forms": "bsd",
    "permission to use copy modify and or distribute this software": "isc",
    "licensed under cc by 4 0": "cc-by-4.0",
    "licensed under cc by sa 4 0": "cc-by-sa-4.0",
    "licensed under cc by nc 4 0": "cc-by-nc-4.0",
    "licensed under cc by nd 4 0": "cc-by-nd-4.0",
    "released into the public domain": "public-domain",
    "all rights reserved": "all-rights-reserved",
}

WORD_BYTES = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)
WORDS = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def max_edits(notice: str) -> int:
    """One edit for each 12 characters, three at most; short code-like endings stay exact enough to tell versions apart."""
    return 1 if len(notice) < 36 else 2 if len(notice) < 60 else 3


def pieces(notice: str) -> list[tuple[int, str]]:
    """The notice in max_edits + 1 parts of nearly equal length, with their places."""
    parts = max_edits(notice) + 1
    cuts = [len(notice) * k // parts for k in range(parts + 1)]
    return [(a, notice[a:b]) for a, b in zip(cuts, cuts[1:])]


@functools.cache
def searches() -> list[tuple[str, str, int, list[tuple[int, bytes]], object]]:
    import regex

    return [
        (notice, label, max_edits(notice), [(at, seed.encode()) for at, seed in pieces(notice)],
         regex.compile(rf"(?b)\b(?:{regex.escape(notice)}){{e<={max_edits(notice)}}}\b"))
        for notice, label in NOTICES.items()
    ]


def places(words: bytes, phrase: bytes) -> list[int]:
    """Every place of the phrase as whole words; `words` begins and ends with a space."""
    found, at = [], words.find(b" " + phrase + b" ")
    while at >= 0:
        found.append(at)
        at = words.find(b" " + phrase + b" ", at + 1)
    return found


def fuzzy(words: bytes, spaces: np.ndarray) -> list[tuple[str, str, int, int, int]]:
    """(label, notice, first word, last word, edits) of every notice, none overlapping another of its own; `spaces` are the places of spaces."""
    found = []
    for notice, label, edits, seeds, pattern in searches():
        windows = []
        for at, seed in seeds:
            hit = words.find(seed)
            while hit >= 0:
                # one edit may put in a character of up to four bytes
                windows.append((max(0, hit - at - 4 * edits - 1), min(len(words), hit - at + len(notice) + 4 * edits + 2)))
                hit = words.find(seed, hit + 1)
        spans = []
        for start, end in parts(merged(windows), len(notice) + 8 * edits + 4):
            while words[start] & 0xC0 == 0x80:  # inside a character
                start += 1
            cut = (start > 0 and words[start - 1 : start + 1].find(b" ") < 0, end < len(words) and words[end - 1 : end + 1].find(b" ") < 0)
            window = words[start:end].decode("utf-8", "ignore")
            for m in matches(pattern, window):
                if m.start() == 0 and cut[0] or m.end() == len(window) and cut[1]:
                    continue  # begins or ends where a word was cut
                text = m.group()
                begin = start + len(window[: m.start()].encode()) + len(text) - len(text.lstrip())
                spans.append((sum(m.fuzzy_counts), begin, begin + len(text.strip().encode())))
        for cost, begin, end in apart(set(spans)):
            first, last = np.searchsorted(spaces, (begin, end)).tolist()
            found.append((label, notice, first - 1, last - 1, cost))
    return closest(found)


def parts(windows: list[tuple[int, int]], longest: int):
    """Windows cut to four times the longest match; neighbours overlap by one of it, so that each match lies whole in one."""
    for start, end in windows:
        while end - start > 4 * longest:
            yield start, start + 4 * longest
            start += 3 * longest
        yield start, end


def matches(pattern, window: str) -> list:
    """Matches of a short window, none overlapping: the best one, then the best of the parts before and after it.

    The pattern's best match of a part may leave others with more edits on either side.
    """
    found, open_ = [], [(0, len(window))]
    while open_:
        start, end = open_.pop()
        m = pattern.search(window, start, end)
        if m and m.end() > m.start():
            found.append(m)
            open_ += [(start, m.start()), (m.end(), end)]
    return found


def merged(windows: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted(windows):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


class Places:
    """Intervals that do not overlap, in order."""

    def __init__(self):
        self.starts: list[int] = []
        self.ends: list[int] = []

    def add(self, start: int, end: int) -> bool:
        """Put in an interval (both ends included) if none is in its way."""
        k = bisect_right(self.starts, end)
        if k and self.ends[k - 1] >= start:
            return False
        self.starts.insert(k, start)
        self.ends.insert(k, end)
        return True


def apart(spans) -> list[tuple[int, int, int]]:
    """Of (edits, start, end) those with fewer edits, then the earlier, none overlapping another."""
    taken = Places()
    return [x for x in sorted(spans) if taken.add(x[1], x[2] - 1)]


def closest(found):
    """Where two notices claim the same words, the one with fewer edits (then the longer, then the earlier) stays."""
    taken = Places()
    kept = [x for x in sorted(found, key=lambda x: (x[4], -len(x[1]), x[2], x[1])) if taken.add(x[2], x[3])]
    return sorted(kept, key=lambda x: (x[2], x[1]))


def char_spans(body: bytes, found) -> list[dict]:
    """The spans of the notices in code points of the text."""
    if not found:
        return []
    wanted = {x[2] for x in found} | {x[3] for x in found}
    edges = {k: m.span() for k, m in enumerate(WORDS.finditer(body)) if k in wanted}
    chars, at, n = {0: 0}, 0, 0
    for place in sorted({p for span in edges.values() for p in span}):  # one pass, from place to place
        n += len(body[at:place].decode("utf-8", "ignore"))
        chars[place], at = n, place
    return [
        {"label": label, "start": chars[edges[first][0]], "end": chars[edges[last][1]], "first_word": first, "last_word": last, "edits": edits}
        for label, _, first, last, edits in found
    ]


def scan_one(body: bytes | None) -> tuple:
    if not body:
        return 0, 0, None, None, [], [], 0.0, []
    split = body.translate(WORD_BYTES).split()
    words = b" " + b" ".join(split) + b" "
    spaces = np.flatnonzero(np.frombuffer(words, np.uint8) == 32)
    starts, base = [], set()
    for phrase, label in PHRASES.items():
        at = places(words, phrase.encode())
        starts += np.searchsorted(spaces, at).tolist()
        base |= {label} if at else set()
    found = fuzzy(words, spaces)
    labels = sorted(base | {x[0] for x in found})
    score = 1.0 if base else max((1 - edits / len(notice) for _, notice, _, _, edits in found), default=0.0)
    return (
        len(split), len(starts), min(starts, default=None), max(starts, default=None), sorted(base), labels, score,
        char_spans(body, found),
    )


FIELDS = [
    field("n_words", "bigint"), field("n_base", "bigint"), field("first_word", "bigint"), field("last_word", "bigint"),
    field("base_found", strings()), field("found", strings()), field("score", "double"),
    field("notices", structs(label="string", start="bigint", end="bigint", first_word="bigint", last_word="bigint", edits="bigint")),
]


def scan(docs: DataFrame, carry: list[str] | None = None, text: str = "text") -> DataFrame:
    """`row` (the carried columns) and what the scan found; `notices` holds the spans in code points and in words."""
    return map_bodies(docs, lambda bodies: list(zip(*map(scan_one, bodies))), FIELDS, carry, text)


def license_report(docs: DataFrame) -> DataFrame:
    """doc_id, word and place counts, the labels, a score, and the notices as label:start:end:edits."""
    spans = F.transform("notices", lambda x: F.concat_ws(":", x["label"], x["start"], x["end"], x["edits"]))
    return unpacked(
        scan(docs, ["doc_id"]), "n_words", "n_base", "first_word", "last_word",
        F.array_join("base_found", ",").alias("base_labels"), F.array_join("found", ",").alias("labels"), "score",
        F.array_join(spans, ",").alias("notices"),
    )
