"""Sharding by weighted rendezvous hashing of record keys.

A shard's score for a key is -weight / ln(u), where u in (0, 1) is a hash of the key and the shard; the key goes to the shard
of the largest score. A new shard therefore only takes keys into itself, and a weight change moves only what it must.
Slots number a shard's rows from 0 without gaps: rows are numbered within (shard, bucket), buckets being hashes of the
key and the text's checksum, so rows that repeat a key with other texts spread out, and each bucket begins where the counts of the buckets before it end. So no task sorts a whole shard, and no text is
shuffled.

Defined results: null keys hash as one fixed key; null texts have no bytes; rows that repeat a key go to one shard and get
slots of their own; empty tables give no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Buckets that a shard's rows are numbered in, at least, and the rows that a bucket holds on average, at most: buckets grow with the table.
BUCKETS, BUCKET_ROWS = 64, 1_000_000


def rendezvous(key: Column, weights: Sequence[float], seed: int = 0) -> Column:
    """Int: the shard of a key among len(weights) weighted shards; ties go to the lower shard."""
    shards = F.array(*[F.struct(F.lit(i).alias("shard"), F.lit(float(w)).alias("weight")) for i, w in enumerate(weights)])

    def bid(s: Column) -> Column:
        u = (F.shiftrightunsigned(F.xxhash64(key, s["shard"], F.lit(seed)), 11) + F.lit(0.5)) / F.lit(float(1 << 53))
        return F.struct((-s["weight"] / F.log(u)).alias("score"), (-s["shard"]).alias("lower"))

    return (-F.array_max(F.transform(shards, bid))["lower"]).cast("int")


def shard_rows(docs: DataFrame, shards: int = 40, weights: Sequence[float] | None = None, fixed: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, size, text_crc32, law, shard, slot, grown_shard); grown_shard is the shard if there were one more of weight 1.

    Rows are counted first, to choose the number of buckets; the counts that are broadcast are one for about BUCKET_ROWS rows.
    """
    weights = list(weights or [1.0] * shards)
    buckets = max(BUCKETS, -(-docs.count() // (len(weights) * BUCKET_ROWS)))
    text, key = F.coalesce(F.col(text_col).cast("string"), F.lit("")), F.col(id_col).cast("string")
    crc = F.crc32(text.cast("binary"))
    placed = docs.select(
        F.col(id_col),
        (F.octet_length(text) + F.lit(fixed)).cast("long").alias("size"),
        crc.alias("text_crc32"),
        rendezvous(key, weights).alias("shard"),
        rendezvous(key, [*weights, 1.0]).alias("grown_shard"),
        F.pmod(F.xxhash64(key, crc, F.lit("slot")), F.lit(buckets)).cast("int").alias("bucket"),
    )
    counts = placed.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("shard").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    begins = counts.select("shard", "bucket", before.alias("begin"))
    order = W.partitionBy("shard", "bucket").orderBy(F.col(id_col), "text_crc32", "size")
    numbered = placed.withColumn("place", F.row_number().over(order) - 1).join(F.broadcast(begins), ["shard", "bucket"])
    return numbered.select(id_col, "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("begin") + F.col("place")).cast("long").alias("slot"), "grown_shard")
