"""Byte-level BPE encoding and decoding by the ranks of a token file, as the tiktoken library defines them.

A text is split by the public pattern. A pre-token that is a token itself is that token; any other starts as its bytes.
A segment tree over its byte positions holds, at each leaf, the rank of the pair that begins there, and at its root the
leftmost smallest; a merge takes the root's pair and makes point updates on the leaves of the live neighbours, each
logarithmic in the length. The trees of many new pre-tokens of one size class stand side by side in one array, so a
step merges one pair in each; few of a class, and so very long ones, have a tree of their own each. Encoded pre-tokens
are kept in each worker in a dictionary that is bounded in entries and bytes.

Defined results: null texts count as empty; the empty text has no ids; texts of any length and repeated rows
are encoded row by row; input columns beside the text are carried along, and clash only with the name that is asked for.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bpe_tables import NONE, PATTERN, PairTable, rank_pairs, read_ranks, splitter
from .common import slices, unused
from .shingles import blocks

#: Pre-tokens that a worker remembers, and bytes of them and their ids; the memory is emptied when they are more.
REMEMBERED, REMEMBERED_BYTES = 150_000, 1 << 24
#: Pre-tokens of a size class from which their trees are worked on together.
TOGETHER = 12
#: Leaves of the trees that are worked on at once.
LEAVES = 1 << 17
_POS = 32


class Ranks:
    """The tokens of a rank file."""

    def __init__(self, path: str, pattern: str = PATTERN):
        self.ids = read_ranks(path)
        self.of_byte = np.array([self.ids[bytes([b])] for b in range(256)], dtype=np.int64)
        pairs = list(rank_pairs(self.ids))
        self.pairs, self.rank = PairTable(pairs), {a << _POS | b: r for a, b, r in pairs}
        self.split = splitter(pattern)
        self.known: dict[str, bytes] = {}
        self.bytes = 0

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        words = [self.split(t) for t in texts]
        new = set(chain.from_iterable(words)).difference(self.known)
        if len(self.known) > REMEMBERED or self.bytes > REMEMBERED_BYTES:
            self.known.clear()
            self.bytes = 0
            new = set(chain.from_iterable(words))
        self.learn(new)
        known = self.known.__getitem__
        return [b"".join(map(known, w)) for w in words]

    def learn(self, new: set[str]) -> None:
        classes: dict[int, list[tuple[str, bytes]]] = {}
        for w in new:
            raw = w.encode("utf-8", "surrogatepass")
            found = self.ids.get(raw)
            self.bytes += 2 * len(raw)
            if found is not None:
                self.known[w] = found.to_bytes(4, "little")
            else:
                classes.setdefault(max(2, (len(raw) - 1).bit_length()), []).append((w, raw))
        for bits, group in classes.items():
            step = max(1, LEAVES >> bits)
            if min(step, len(group)) < TOGETHER:
                self.known.update((w, self.merge_one(raw)) for w, raw in group)
                continue
            for i in range(0, len(group), step):
                part = group[i : i + step]
                for (w, _), ids in zip(part, self.merge([raw for _, raw in part], 1 << bits)):
                    self.known[w] = ids

    def merge_one(self, raw: bytes) -> bytes:
        """Ids of one byte string of any length, by one segment tree."""
        n, none, low = len(raw), NONE << _POS, (1 << _POS) - 1
        symbol, after, before = self.of_byte[np.frombuffer(raw, dtype=np.uint8)].tolist(), list(range(1, n + 1)), list(range(-1, n))
        leaves = 1 << max(1, (n - 1).bit_length())
        tree, rank = [none] * (2 * leaves), self.rank.get
        for i in range(n - 1):
            found = rank(symbol[i] << _POS | symbol[i + 1])
            if found is not None:
                tree[leaves + i] = found << _POS | i
        for i in range(leaves - 1, 0, -1):
            tree[i] = min(tree[2 * i], tree[2 * i + 1])

        def put(at: int, value: int) -> None:
            at += leaves
            tree[at] = value
            while at > 1:
                value = min(value, tree[at ^ 1])
                at >>= 1
                if tree[at] == value:
                    break
                tree[at] = value

        while tree[1] < none:
            at, symbol_ = tree[1] & low, tree[1] >> _POS
            gone = after[at]
            then, prev = after[gone], before[at]
            symbol[at], symbol[gone], after[at], before[then] = symbol_, -1, then, at
            put(gone, none)
            found = rank(symbol_ << _POS | symbol[then]) if then < n else None
            put(at, none if found is None else found << _POS | at)
            if prev >= 0:
                found = rank(symbol[prev] << _POS | symbol_)
                put(prev, none if found is None else found << _POS | prev)
        return np.array([s for s in symbol if s >= 0], dtype="<u4").tobytes()

    def merge(self, raws: list[bytes], leaves: int) -> list[bytes]:
        """Ids of byte strings of at most ``leaves`` bytes, each by a segment tree of its own."""
        n, wide = len(raws), leaves + 1
        size = np.array([len(r) for r in raws])
        live = np.arange(leaves)[None, :] < size[:, None]
        symbol = np.zeros((n, wide), dtype=np.int64)
        symbol[:, :leaves][live] = self.of_byte[np.frombuffer(b"".join(raws), dtype=np.uint8)]
        place = np.arange(wide, dtype=np.int64)
        after = np.where(place[None, :] + 1 < size[:, None], place[None, :] + 1, leaves)
        before = np.repeat(place[None, :] - 1, n, axis=0)
        none = NONE << _POS
        tree = np.full((n, 2 * leaves), none, dtype=np.int64)
        pair = np.flatnonzero((live & (place[None, :leaves] + 1 < size[:, None])).ravel())
        row, col = pair // leaves, pair % leaves
        tree[row, leaves + col] = (self.pairs.get(symbol[row, col], symbol[row, col + 1]) << _POS) | col
        k = leaves // 2
        while k:
            tree[:, k : 2 * k] = np.minimum(tree[:, 2 * k : 4 * k : 2], tree[:, 2 * k + 1 : 4 * k : 2])
            k //= 2
        tree, symbol, after, before, live = (x.ravel() for x in (tree, symbol, after, before, live))

        def put(rows: np.ndarray, at: np.ndarray, value: np.ndarray | np.int64) -> None:
            base, node = rows * (2 * leaves), at + leaves
            tree[base + node] = value
            while leaves > 1:
                node = node >> 1
                tree[base + node] = np.minimum(tree[base + 2 * node], tree[base + 2 * node + 1])
                if node[0] == 1:
                    break

        rows = np.arange(n)
        while True:
            top = tree[rows * (2 * leaves) + 1]
            rows, top = rows[top < none], top[top < none]
            if not len(rows):
                break
            at, to = top & ((1 << _POS) - 1), top >> _POS
            line = rows * wide
            gone = after[line + at]
            then = after[line + gone]
            symbol[line + at] = to
            after[line + at] = then
            before[line + then] = at
            live[rows * leaves + gone] = False
            put(rows, gone, none)
            right = np.where(then < leaves, (self.pairs.get(to, symbol[line + then]) << _POS) | at, none)
            put(rows, at, np.where(right >= none, none, right))
            prev = before[line + at]
            has = prev >= 0
            if has.any():
                r, p = rows[has], prev[has]
                left = (self.pairs.get(symbol[r * wide + p], to[has]) << _POS) | p
                put(r, p, np.where(left >= none, none, left))
        live = live.reshape(n, leaves)
        flat = symbol.reshape(n, wide)[:, :leaves][live].astype("<u4").tobytes()
        ends = (np.cumsum(live.sum(axis=1)) * 4).tolist()
        return [flat[a:b] for a, b in zip([0, *ends], ends)]


@lru_cache(maxsize=2)
def ranks(path: str, pattern: str = PATTERN) -> Ranks:
    """One table for each worker process."""
    return Ranks(path, pattern)


@lru_cache(maxsize=2)
def tokens(path: str) -> dict[int, bytes]:
    """The bytes of each id, one table for each worker process."""
    return {i: t for t, i in read_ranks(path).items()}


def encode_column(text: Column, path: str, pattern: str = PATTERN) -> Column:
    """Binary: the text's ids as little-endian unsigned 32-bit integers; ``ids_of`` gives them as an array."""

    @F.arrow_udf("binary")
    def encode(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        table = ranks(path, pattern)
        for part in slices(parts):
            texts = [t or "" for t in part.to_pylist()]
            yield pa.array([ids for a, b in blocks(texts) for ids in table.encode(texts[a:b])], pa.binary())

    return encode(text)


def decode_column(ids: Column, path: str) -> Column:
    """Binary: the bytes that ids of ``encode_column`` stand for. An id without a token is an error."""

    @F.arrow_udf("binary")
    def decode(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        token = tokens(path).__getitem__
        for part in slices(parts):
            yield pa.array([None if x is None else b"".join(map(token, np.frombuffer(x, dtype="<u4").tolist())) for x in part.to_pylist()], pa.binary())

    return decode(ids)


def coded_column(text: Column, path: str, pattern: str = PATTERN) -> Column:
    """struct<ids, decoded>: what ``encode_column`` gives, and what ``decode_column`` makes of it, by one worker."""

    @F.arrow_udf("ids binary, decoded binary")
    def coded(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        table, token = ranks(path, pattern), tokens(path).__getitem__
        for part in slices(parts):
            texts = [t or "" for t in part.to_pylist()]
            packed = [ids for a, b in blocks(texts) for ids in table.encode(texts[a:b])]
            plain = [b"".join(map(token, np.frombuffer(x, dtype="<u4").tolist())) for x in packed]
            yield pa.StructArray.from_arrays([pa.array(packed, pa.binary()), pa.array(plain, pa.binary())], ["ids", "decoded"])

    return coded(text)


def ids_of(packed: Column) -> Column:
    """array<long>: the ids in a packed binary; null stays null."""

    @F.arrow_udf("array<long>")
    def unpack(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for part in slices(parts):
            yield pa.array([None if x is None else np.frombuffer(x, dtype="<u4").astype(np.int64) for x in part.to_pylist()], pa.list_(pa.int64()))

    return unpack(packed)


def encode(docs: DataFrame, path: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """docs with a column of packed ids."""
    return docs.withColumn(ids_col, encode_column(F.col(text_col), path))


def decode(rows: DataFrame, path: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """rows with a column of the bytes that their packed ids stand for."""
    return rows.withColumn(out_col, decode_column(F.col(ids_col), path))


def round_trip(docs: DataFrame, path: str, text_col: str = "text", ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """docs with a column of packed ids and a column of the bytes that they decode to, in one pass."""
    name = unused(docs, "coded")
    both = docs.withColumn(name, coded_column(F.col(text_col), path))
    return both.withColumns({ids_col: F.col(name)["ids"], out_col: F.col(name)["decoded"]}).drop(name)
