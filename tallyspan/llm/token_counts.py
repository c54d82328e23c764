"""Token counts of a byte-level BPE tokenizer file, by rank-synchronous merging.

The new pre-tokens of a batch lie as one ragged numpy array of symbols. In each round every sequence applies its lowest-ranked
pair at all its places at once, left to right where places overlap, and the symbols that are left are counted when a
sequence has no pair to merge. A merged symbol ranks after what it is made of, so a round never hides a lower rank.
Counts of pre-tokens are kept in a bounded dictionary in each worker.

Added tokens of the file that stand in a text count as one each, as the tokenizers library does by default.

Defined results: null and empty texts have 0 tokens; texts of any length count whole; repeated rows count alike.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bpe_tables import NONE, PATTERN, PairTable, read_merges, splitter
from .common import slices
from .shingles import blocks

#: Pre-tokens that a worker remembers, and bytes of them; the memory is emptied when they are more.
REMEMBERED, REMEMBERED_BYTES = 250_000, 1 << 24
#: Symbols that are merged at once.
SYMBOLS = 1 << 20


class Merges:
    """The merges of a tokenizer file."""

    def __init__(self, path: str):
        ids, merges, added = read_merges(path)
        self.of_byte = np.array(ids, dtype=np.int64)
        self.rank = PairTable((a, b, r) for r, (a, b, _) in enumerate(merges))
        self.result = np.array([c for _, _, c in merges], dtype=np.int64)
        self.added = re.compile("|".join(map(re.escape, sorted(added, key=len, reverse=True)))) if added else None
        self.split = splitter(PATTERN)
        self.known: dict[str, int] = {}
        self.bytes = 0

    def words(self, text: str) -> tuple[list[str], int]:
        """Pre-tokens of a text, and the number of added tokens between them."""
        if self.added is None or not self.added.search(text):
            return self.split(text), 0
        parts = self.added.split(text)
        return list(chain.from_iterable(map(self.split, parts))), len(parts) - 1

    def count(self, texts: list[str]) -> list[int]:
        found = [self.words(t) for t in texts]
        words = [w for w, _ in found]
        if len(self.known) > REMEMBERED or self.bytes > REMEMBERED_BYTES:
            self.known.clear()
            self.bytes = 0
        new = list(set(chain.from_iterable(words)).difference(self.known))
        raws = [w.encode("utf-8", "surrogatepass") for w in new]
        ends = np.cumsum([len(r) for r in raws])
        self.bytes += int(ends[-1]) if new else 0
        a = 0
        while a < len(new):
            b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + SYMBOLS)))
            self.known.update(zip(new[a:b], self.merged(raws[a:b]).tolist()))
            a = b
        known = self.known.__getitem__
        return [sum(map(known, w)) + extra for w, extra in found]

    def merged(self, raws: list[bytes]) -> np.ndarray:
        """The number of symbols left of each byte string."""
        size = np.array([len(r) for r in raws], dtype=np.int64)
        counts = size.copy()
        symbol = self.of_byte[np.frombuffer(b"".join(raws), dtype=np.uint8)]
        owner = np.repeat(np.arange(len(raws)), size)
        while len(symbol) > 1:
            pair = owner[1:] == owner[:-1]
            rank = np.where(pair, self.rank.get(symbol[:-1], symbol[1:]), NONE)
            first = np.flatnonzero(np.concatenate([[True], ~pair]))
            least = np.minimum.reduceat(np.concatenate([rank, [NONE]]), first)
            span = np.diff(np.append(first, len(symbol)))
            least_at = np.repeat(least, span)
            chosen = (rank == least_at[:-1]) & (rank < NONE)
            at = np.flatnonzero(chosen)
            if not len(at):
                break
            run = np.concatenate([[True], at[1:] != at[:-1] + 1])
            begin = np.maximum.accumulate(np.where(run, np.arange(len(at)), 0))
            at = at[(np.arange(len(at)) - begin) % 2 == 0]
            symbol[at] = self.result[rank[at]]
            stay = least_at < NONE
            stay[at + 1] = False
            counts -= np.bincount(owner[at], minlength=len(counts))
            symbol, owner = symbol[stay], owner[stay]
        return counts


@lru_cache(maxsize=2)
def merges(path: str) -> Merges:
    """One table for each worker process."""
    return Merges(path)


def count_column(text: Column, path: str) -> Column:
    """Long: the number of tokens of a text."""

    @F.arrow_udf("long")
    def count(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        table = merges(path)
        for part in slices(parts):
            texts = [t or "" for t in part.to_pylist()]
            yield pa.array([n for a, b in blocks(texts) for n in table.count(texts[a:b])], pa.int64())

    return count(text)


def count_tokens(docs: DataFrame, path: str, limit: int = 1024, text_col: str = "text") -> DataFrame:
    """docs with n_bytes (UTF-8), n_tokens and over_limit."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    out = docs.withColumn("n_tokens", count_column(text, path))
    return out.withColumn("n_bytes", F.octet_length(text).cast("long")).withColumn("over_limit", F.col("n_tokens") > limit)
