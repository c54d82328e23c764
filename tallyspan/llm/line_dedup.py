"""Line dedup: documents probe compact arrays under a sharded minimal perfect hash; lines are never joined.

A line's key is a 128-bit digest of the line, stripped and with A-Z lower-cased. Keys are counted by documents. Those that enough documents
hold are dealt into shards of about ``SHARD_KEYS`` keys, and each shard becomes one row: a minimal perfect hash of
its keys, and under it arrays of fingerprints, document counts and keepers (the smallest id). A document's distinct
keys go to their shard with the document's id, and are looked up in the arrays; a fingerprint that differs tells keys that the shard does not hold.
Only keys to drop come back to the document.

A key that very many documents hold is counted with partial sums in each task, and the probes of a shard are dealt over as many salts as
hold about ``PROBES`` each, with the shard's row repeated once a salt. So a group holds one shard and a bounded number of probes.

The hash has levels: each key that is alone at its bit of a level stays there, the others go on to the next; a key's
number is the count of bits set before its own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, slices, unused, workspace

#: Keys of a shard, and probes of one group, on average.
SHARD_KEYS, PROBES = 1 << 12, 1 << 16
#: Bits of a level for each key that is left.
BITS_A_KEY = 2
_SPACE = b" \t\n\x0b\x0c\r"
_KEY = 16


def key_of(line: bytes, least_chars: int) -> bytes | None:
    """The digest of a line's key; None where the key has too few code points."""
    line = line.strip(_SPACE).lower()
    short = len(line) < least_chars or (len(line) < 4 * least_chars and len(line.decode("utf-8", "replace")) < least_chars)
    return None if short else hashlib.blake2b(line, digest_size=_KEY).digest()


def _mixed(keys: np.ndarray, seed: int) -> np.ndarray:
    """Another hash of (n, 2) words for each seed."""
    with np.errstate(over="ignore"):
        x = (keys[:, 0] + np.uint64(seed) * np.uint64(0x9E3779B97F4A7C15)) ^ (keys[:, 1] * np.uint64(2 * seed + 1))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class PerfectHash:
    """Numbers 0 to n - 1 for n different keys of two words each; other keys get some number or -1."""

    def __init__(self, sizes: list[int], words: np.ndarray):
        self.sizes, self.words = sizes, words
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(words).astype(np.int64))])

    @classmethod
    def of(cls, keys: np.ndarray) -> PerfectHash:
        sizes, levels = [], []
        while len(keys):
            size = 64 * max(1, -(-BITS_A_KEY * len(keys) // 64))
            at = (_mixed(keys, len(sizes)) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            levels.append(np.packbits(alone, bitorder="little").view("<u8"))
            sizes.append(size)
            keys = keys[~alone[at]]
        return cls(sizes, np.concatenate(levels) if levels else np.zeros(0, "<u8"))

    def numbers(self, keys: np.ndarray) -> np.ndarray:
        out, left, first = np.full(len(keys), -1), np.arange(len(keys)), 0
        for level, size in enumerate(self.sizes):
            at = first + (_mixed(keys[left], level) % np.uint64(size)).astype(np.int64)
            word, bit = self.words[at >> 6], (at & 63).astype(np.uint64)
            here = (word >> bit) & np.uint64(1) == 1
            below = np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1)))
            out[left[here]] = (self.before[at >> 6] + below)[here]
            left, first = left[~here], first + size
        return out


def _words(keys: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(keys.to_pylist()), "<u8").reshape(-1, 2)


def _built(table: pa.Table) -> pa.Table:
    """One row of arrays for a shard's keys."""
    keys = _words(table["key"])
    hashed = PerfectHash.of(keys)
    place = hashed.numbers(keys)
    prints, counts, keepers = np.empty(len(keys), "<u8"), np.empty(len(keys), "<u4"), np.empty(len(keys), "<i8")
    prints[place] = keys[:, 1]
    counts[place] = np.minimum(table["docs"].to_numpy(), 2**32 - 1)
    keepers[place] = table["keeper"].to_numpy()
    arrays = [a.tobytes() for a in (hashed.words, prints, counts, keepers)]
    return pa.table({"shard": table["shard"][:1], "sizes": pa.array([hashed.sizes], pa.list_(pa.int64()))} | {n: pa.array([a], pa.binary()) for n, a in zip(_ARRAYS, arrays)})


_ARRAYS = ("words", "prints", "counts", "keepers")


def _probed(least_docs: int):
    def run(probes: pa.Table, shard: pa.Table) -> pa.Table:
        if shard.num_rows and probes.num_rows:
            row = shard.slice(0, 1).to_pylist()[0]
            words, prints, counts, keepers = (np.frombuffer(row[n], t) for n, t in zip(_ARRAYS, ("<u8", "<u8", "<u4", "<i8")))
            keys = _words(probes["key"])
            at = PerfectHash(row["sizes"], words).numbers(keys)
            held = (at >= 0) & (prints[at] == keys[:, 1]) & (counts[at] >= least_docs)
            probes = probes.filter(pa.array(held & (keepers[at] != probes["doc"].to_numpy())))
        else:
            probes = probes.slice(0, 0)
        return probes.select(["doc", "text_hash", "key"])

    return run


def _keys(least_chars: int):
    """(doc, text_hash, key) for each different key of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [list({k for line in t.split(b"\n") if (k := key_of(line, least_chars))}) for t in batch["text"].to_pylist()]
            rows = pa.array(np.repeat(np.arange(len(found)), [len(f) for f in found]))
            own = batch.select(["doc", "text_hash"]).take(rows)
            yield pa.RecordBatch.from_arrays([*own.columns, pa.array([k for f in found for k in f], pa.binary())], names=["doc", "text_hash", "key"])

    return run


def index(keys: DataFrame, shards: Column) -> DataFrame:
    """The arrays of (key, docs, keeper), one row a shard: (shard, sizes, words, prints, counts, keepers)."""
    schema = "shard int, sizes array<long>, words binary, prints binary, counts binary, keepers binary"
    return keys.withColumn("shard", _shard(shards)).groupBy("shard").applyInArrow(_built, schema)


def _shard(shards: Column) -> Column:
    return F.pmod(F.xxhash64("key"), shards).cast("int")


def _rest(least_chars: int, text: Column, gone: Column) -> Column:
    @F.arrow_udf("struct<n_lines: long, n_dropped: long, kept: string>")
    def run(parts: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, gones in ((t.slice(a, 256), g.slice(a, 256)) for t, g in parts for a in range(0, max(1, len(t)), 256)):
            out = []
            for t, g in zip(texts.to_pylist(), gones.to_pylist()):
                lines = t.split(b"\n")
                if g:
                    drop = set(g)
                    rest = [x for x in lines if key_of(x, least_chars) not in drop]
                    out.append((len(lines), len(lines) - len(rest), b"\n".join(rest)))
                else:
                    out.append((len(lines), 0, t))
            cols = [pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.int64()), pa.array([o[2] for o in out], pa.binary()).cast(pa.string())]
            yield pa.StructArray.from_arrays(cols, names=["n_lines", "n_dropped", "kept"])

    return run(text, gone)


def drop_repeated_lines(docs: DataFrame, least_chars: int = 10, least_docs: int = 2, id_col: str = "doc_id", text_col: str = "text", out_col: str = "lines") -> DataFrame:
    """docs with a last column out_col: struct of n_lines, n_dropped and kept, the text without its dropped lines.

    Lines whose key has least_chars code points and stands in least_docs documents stay in the document of the smallest
    id alone. A null or empty text is one empty line, and kept is then empty. Rows that repeat an id are one document: their
    lines count once, and all of them keep what their id keeps. Rows without an integer id keep every line and count for none.
    Extra columns come through; out_col gets underscores while docs has a column of its name. An empty table stays empty.
    The keys' tables are deleted; the keys to drop stand as a table in the shared folder.
    """
    spark = docs.sparkSession
    doc, text = F.col(id_col).cast("long"), F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    with workspace(spark) as folder:
        rows = docs.select(doc.alias("doc"), F.xxhash64(text).alias("text_hash"), text.cast("binary").alias("text")).where("doc is not null")
        lines = cut(rows.mapInArrow(_keys(least_chars), "doc long, text_hash long, key binary"), folder)
        counted = lines.groupBy("key").agg(F.count_distinct("doc").alias("docs"), F.min("doc").alias("keeper")).where(F.col("docs") >= least_docs)
        counted = cut(counted, folder)
        shards = F.lit(max(1, -(-counted.count() // SHARD_KEYS)))
        lines = lines.withColumn("shard", _shard(shards))
        salts = lines.groupBy("shard").agg(F.ceil(F.count("*") / PROBES).cast("int").alias("salts"))
        arrays = index(counted, shards).join(salts, "shard").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")
        dealt = lines.join(salts, "shard").withColumn("salt", F.pmod(F.xxhash64("doc", "text_hash"), F.col("salts")).cast("int")).drop("salts")
        met = dealt.groupBy("shard", "salt").cogroup(arrays.groupBy("shard", "salt"))
        gone = met.applyInArrow(_probed(least_docs), "doc long, text_hash long, key binary").distinct()
        gone = cut(gone.groupBy("doc", "text_hash").agg(F.collect_list("key").alias("gone")))
    names = {c: unused(docs, c) for c in ("doc", "text_hash", "gone")}
    left = docs.withColumns({names["doc"]: doc, names["text_hash"]: F.xxhash64(text)})
    joined = left.join(gone.withColumnsRenamed(names), [names["doc"], names["text_hash"]], "left")
    return joined.select(*docs.columns, _rest(least_chars, text.cast("binary"), F.col(names["gone"])).alias(unused(docs, out_col)))
