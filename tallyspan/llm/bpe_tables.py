"""What the two byte-level BPE operators share: reading rank files, pre-tokens, and a hashed table of symbol pairs."""

from __future__ import annotations

import base64
import json
import re
from collections.abc import Callable, Iterable

import numpy as np
import regex

#: The public pattern that splits a text before byte-level merges, and its classes within Latin-1.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
LATIN_LETTERS = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff"
LATIN_NUMBERS = "0-9\xb2\xb3\xb9\xbc-\xbe"
LATIN_SPACES = "\t-\r \x85\xa0"

#: A rank above all others: no merge.
NONE = np.int64(1 << 20)


def splitter(pattern: str = PATTERN) -> Callable[[str], list[str]]:
    """findall of the pattern. For the public pattern a text within Latin-1 takes an equivalent one of plain classes."""
    wide = regex.compile(pattern).findall
    if pattern != PATTERN:
        return wide
    letters, numbers, spaces = LATIN_LETTERS, LATIN_NUMBERS, LATIN_SPACES
    narrow = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{letters}]+| ?[{numbers}]+| ?[^{spaces}{letters}{numbers}]+|[{spaces}]+(?![^{spaces}])|[{spaces}]+").findall

    def split(text: str) -> list[str]:
        if text.isascii():
            return narrow(text)
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return wide(text)
        return narrow(text)

    return split


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: a base64 token and its rank on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def byte_alphabet() -> dict[str, int]:
    """The printable characters that stand for the 256 bytes in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(c): b for b, c in [*zip(plain, plain), *zip(rest, range(256, 512))]}


def read_merges(path: str) -> tuple[list[int], list[tuple[int, int, int]], dict[str, int]]:
    """A tokenizer's JSON: ids of the 256 bytes, merges as (left, right, result) by rank, and ids of added tokens."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    vocab = spec["model"]["vocab"]
    of = byte_alphabet()
    ids = [0] * 256
    for c, b in of.items():
        ids[b] = vocab[c]
    merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
    return ids, [(vocab[a], vocab[b], vocab[a + b]) for a, b in merges], {t["content"]: t["id"] for t in spec["added_tokens"]}


def rank_pairs(ranks: dict[bytes, int]) -> Iterable[tuple[int, int, int]]:
    """Every two tokens that make a token, as (left, right, rank)."""
    for token, rank in ranks.items():
        for i in range(1, len(token)):
            a, b = ranks.get(token[:i]), ranks.get(token[i:])
            if a is not None and b is not None:
                yield a, b, rank


class PairTable:
    """An open-addressing table from pairs of symbols to values, looked up for whole arrays at once."""

    def __init__(self, pairs: Iterable[tuple[int, int, int]]):
        rows = np.array(list(pairs), dtype=np.int64).reshape(-1, 3)
        keys, values = (rows[:, 0] << 32) | rows[:, 1], rows[:, 2]
        self.bits = max(4, int(len(keys) * 3).bit_length())
        size = 1 << self.bits
        self.keys, self.values = np.full(size, -1, dtype=np.int64), np.full(size, NONE, dtype=np.int64)
        slot = self._slot(keys)
        while len(keys):
            free = np.flatnonzero(self.keys[slot] == -1)
            self.keys[slot[free]] = keys[free]
            placed = self.keys[slot] == keys
            self.values[slot[placed]] = values[placed]
            keys, values, slot = keys[~placed], values[~placed], (slot[~placed] + 1) & (size - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = (left.astype(np.int64) << 32) | right.astype(np.int64)
        slot = self._slot(keys)
        found = self.keys[slot]
        out = np.where(found == keys, self.values[slot], NONE)
        todo = np.flatnonzero((found != keys) & (found != -1))
        at = slot[todo]
        while len(todo):
            at = (at + 1) & (len(self.keys) - 1)
            found = self.keys[at]
            hit = found == keys[todo]
            out[todo[hit]] = self.values[at[hit]]
            go = ~hit & (found != -1)
            todo, at = todo[go], at[go]
        return out
