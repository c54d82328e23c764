"""The registered queries of this subpackage, and DuckDB SQL for those that SQL can express.

Each query applies one operator with production parameters to its whole table and derives the columns that its contract names.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, jaccard, langid, licenses, line_dedup, media, mixing, neardup, sharding, spelling, token_counts, toxicity, whitening

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out() -> Column:
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = toxicity.train(docs.where(~held_out()), _table(spark, sf_dir, "labels"))
    out = toxicity.score(docs, model).select("doc_id", held_out().alias("held_out"), "score")
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_groups(_table(spark, sf_dir, "documents"), size=4, percent=85)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = langid.train(docs.where(~held_out()))
    out = langid.predict(docs, model).select("doc_id", held_out().alias("held_out"), "language")
    return out.select("doc_id", "held_out", "language.lang_pred", "language.score")


def op4_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_rows(_table(spark, sf_dir, "documents"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without rate and copies, which its SQL doesn't have; ``op6_mixing_copies`` gives them."""
    return mixing.mix(_table(spark, sf_dir, "documents")).drop("rate", "copies")


def op6_mixing_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents")).select("doc_id", *mixing.MARGINS, "tokens", "target", "rate", "copies")


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = bpe.round_trip(_table(spark, sf_dir, "documents").select("doc_id", "text"), RANKS)
    return rows.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op8_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = media.media_columns(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    track, size = F.col("track"), F.octet_length("payload")
    feature = F.concat_ws(
        " ",
        track["codec"],
        F.concat(track["duration"].cast("string"), F.lit("/"), track["time_scale"].cast("string"), F.lit("s")),
        F.concat(track["samples"].cast("string"), F.lit(" samples")),
        F.concat(F.size(track["key_frames"]).cast("string"), F.lit(" keys")),
        F.concat(F.lit("last "), F.element_at(track["key_frames"], -1)["first"].cast("string"), F.lit("-"), F.element_at(track["key_frames"], -1)["end"].cast("string")),
    )
    return rows.select(
        "doc_id",
        F.coalesce(F.octet_length(F.col("text").cast("string")), F.lit(0)).cast("long").alias("n_bytes"),
        size.cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", size - 15, F.lit(16))).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        feature.alias("feature"),
    )


def op9_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.digest(licenses.scan(_table(spark, sf_dir, "documents")))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = token_counts.count_tokens(_table(spark, sf_dir, "documents").select("doc_id", "text"), TOKENIZER)
    return rows.select("doc_id", "n_bytes", "n_tokens", "over_limit")


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = line_dedup.drop_repeated_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc_id", "lines.n_lines", "lines.n_dropped", F.sha2(F.col("lines.kept").cast("binary"), 256).alias("kept_sha256"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(_table(spark, sf_dir, "documents"))


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """deviation is null where the exact sum is beyond a long; the operator has all its digits."""
    rows = whitening.whiten(_table(spark, sf_dir, "embeddings"))
    rows = rows.select("vec_id", "n", "deviation", "identity_error", F.posexplode(F.arrays_zip("whitened", "explained")))
    shown = [(F.col("pos") + 1).alias("component"), "n", F.expr("try_cast(deviation AS bigint)").alias("deviation"), "col.whitened", "col.explained", "identity_error"]
    return rows.select("vec_id", *shown)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_toxicity, op2_ngram_jaccard_join, op3_language_id, op4_embedding_near_dedup, op5_sharding, op6_mixing, op6_mixing_copies, op7_byte_bpe, op8_media_columns, op9_license_scans, op10_token_counts, op11_line_dedup, op12_spelling_variants, op13_embedding_whitening]
    return {f.__name__: f for f in found}


_GROUPS = """, reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)"""

JACCARD_SQL = (
    r"""WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
  ELSE [array_to_string(ws[i:i + 3], ' ') FOR i IN range(1, len(ws) - 2)] END) AS g FROM w),
e AS (SELECT doc_id, unnest(g) AS g FROM s),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n FROM e x JOIN e y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM p JOIN s x ON p.a = x.doc_id JOIN s y ON p.b = y.doc_id WHERE 100 * n >= 85 * (len(x.g) + len(y.g) - n))"""
    + _GROUPS
    + """
SELECT s.doc_id, CAST(len(any_value(g)) AS BIGINT) AS n_shingles, least(s.doc_id, coalesce(min(b), s.doc_id)) AS component_id
FROM s LEFT JOIN reach ON s.doc_id = reach.a GROUP BY s.doc_id"""
)

EMBEDDING_SQL = (
    """WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
g AS (SELECT * FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len([x FOR x IN e IF x IS NULL OR NOT isfinite(x)]) = 0 AND len([x FOR x IN e IF x <> 0]) > 0),
links AS (SELECT x.vec_id AS a, y.vec_id AS b FROM g x JOIN g y ON x.label = y.label AND x.vec_id <> y.vec_id AND len(x.e) = len(y.e)
  WHERE list_cosine_similarity(x.e, y.e) >= 0.93)"""
    + _GROUPS
    + """,
n AS (SELECT a, count(*) AS n FROM links GROUP BY a), m AS (SELECT a, min(b) AS m FROM reach GROUP BY a)
SELECT vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, least(vec_id, coalesce(m.m, vec_id)) AS component_id,
  vec_id = least(vec_id, coalesce(m.m, vec_id)) AS kept
FROM v LEFT JOIN n ON vec_id = n.a LEFT JOIN m ON vec_id = m.a"""
)


_BLANK = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

LINES_SQL = f"""WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM d),
k AS (SELECT *, translate(trim(line, {_BLANK}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
held AS (SELECT key, min(doc_id) AS keeper FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
m AS (SELECT k.*, keeper IS NOT NULL AND keeper <> doc_id AS gone FROM k LEFT JOIN held USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256 FROM m GROUP BY doc_id"""


def oracle_sql() -> dict[str, str]:
    return {"op11_line_dedup": LINES_SQL, "op2_ngram_jaccard_join": JACCARD_SQL, "op4_embedding_near_dedup": EMBEDDING_SQL, "op6_mixing": mixing.oracle(), "op6_mixing_copies": mixing.copies_oracle()}
