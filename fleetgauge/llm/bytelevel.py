"""Byte-level tokenizers of a file, by the tokenizers library and, for ids alone, by tiktoken with the file's own vocabulary.

The second is four times as fast. Both split by the same pattern over classes of
characters; tests compare the classes of every character and the ids of many texts.
"""

from __future__ import annotations

import functools
import json
import os
import re

#: Fixed value: the splitting pattern that a ByteLevel pre-tokenizer stands for.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def unproven(spec: dict) -> str | None:
    """Why a file's tokenizer is not one that splits by this pattern and nothing else, or None."""
    splitting, model = spec.get("pre_tokenizer") or {}, spec.get("model") or {}
    if spec.get("normalizer") is not None:
        return "it has a normalizer"
    if splitting.get("type") != "ByteLevel" or not splitting.get("use_regex", True) or splitting.get("add_prefix_space"):
        return "its words are not those of the byte-level pattern"
    if model.get("type") != "BPE" or any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges")):
        return "its model is not plain byte-level BPE"
    for token in spec.get("added_tokens") or []:
        if token["single_word"] or token["lstrip"] or token["rstrip"] or token["normalized"] or re.search(r"\s", token["content"]):
            return f"the added token {token['content']!r} looks at what stands around it"
    return None


def read(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    if why := unproven(spec):
        raise ValueError(f"{path}: {why}")
    return spec


@functools.cache
def library(path: str):
    """The file's tokenizer, and how far before the end of a chunk a word has to begin to be certain."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    spec = read(path)
    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer, max(3, *(len(t["content"]) for t in spec.get("added_tokens") or []), 3)


@functools.cache
def encoder(path: str):
    """Ids of the file's tokenizer, as the tokenizers library gives them; a special token's text counts as that token.

    The file's characters stand for bytes: printable ones for themselves, the rest, in
    order, for the characters from 256 on.
    """
    import tiktoken

    spec = read(path)
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in printable}
    byte_of |= {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(printable))}
    ranks = {bytes(byte_of[c] for c in token): i for token, i in spec["model"]["vocab"].items()}
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    for content in special:
        ranks.pop(content.encode(), None)
    return tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)
