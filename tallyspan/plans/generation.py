"""Variants assembled from whole documents, with their SQL. Importing this module registers the query."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import ranges
from ..operators import variants
from .products import _FIELD
from .queries import SQL, query

RULES = variants.Rules("generator", 2, "seeds")
NUMBER = "[0-9]{3,}"
#: What a document is as a case; plain SQL that Spark and DuckDB read alike. Every seventh belongs to a method; n plants another fault.
_CASE = """CASE doc_id % 7 WHEN 0 THEN 'type-validation' WHEN 1 THEN 'context-discrimination' WHEN 2 THEN 'pii-benign' WHEN 3 THEN 'jurisdiction-collision' WHEN 4 THEN 'mutation' WHEN 5 THEN 'reference-differential' ELSE 'schema-only' END AS method,
  concat('case-', CAST(doc_id AS STRING)) AS case_id, concat('s-', CAST(doc_id % 9 AS STRING)) AS case_seed, CASE WHEN doc_id % 5 = 0 AND doc_id % 7 <> 1 THEN 'not-established' ELSE 'valid' END AS type_expectation,
  CASE WHEN doc_id % 3 = 0 THEN 'sensitive' ELSE 'non-sensitive' END AS sensitivity, CAST(floor(doc_id / 7) AS BIGINT) % 6 AS n"""
FRAMES = [("f-a", "Größe {{candidate}}.", "sensitive", "sensitive"), ("f-b", "{{candidate}}", "neutral", "not-established"), ("f-c", "x {{candidate}}", "non-sensitive", "non-sensitive")]

_SLOTS = """SELECT c.*, f.* FROM cases c LEFT JOIN (VALUES ('f-a', 'Größe ', '.', 'sensitive', 'sensitive'), ('f-b', '', '', 'neutral', 'not-established'), ('f-c', 'x ', '', 'non-sensitive', 'non-sensitive')) f(id, head, tail, context, mood)
  ON c.method = 'context-discrimination' AND c.reason IS NULL"""
_REASON = """CASE WHEN token = '' THEN 'range-invalid' WHEN method = 'jurisdiction-collision' THEN CASE WHEN n = 1 THEN 'invalid-collision' END
  WHEN method = 'pii-benign' THEN CASE WHEN sensitivity <> 'non-sensitive' THEN 'not-non-sensitive' WHEN n = 2 THEN 'slot-invalid' END
  WHEN method = 'type-validation' THEN CASE WHEN n = 3 THEN 'missing-validator' WHEN n = 4 AND type_expectation = 'valid' AND NOT ssn THEN 'validator-expectation-mismatch' END WHEN method = 'reference-differential' AND n = 3 THEN 'missing-reference'
  WHEN method = 'mutation' THEN CASE n WHEN 4 THEN 'operator-unknown' WHEN 5 THEN 'operator-version-mismatch' END
  WHEN method = 'context-discrimination' THEN CASE n WHEN 1 THEN 'context-frames-not-a-trio' WHEN 2 THEN 'frame-expectation-mismatch' WHEN 3 THEN 'frame-template-invalid' WHEN 4 THEN 'duplicate-frame' END END"""
_SEED = " || ".join(_FIELD.format(f) for f in ("'seeds'", "'generator'", "'2'", "case_seed", "case_id", "slot"))
_ID = " || ".join(_FIELD.format(f) for f in ("case_id", "slot"))
_SSN = "regexp_full_match(token, '[0-9]{9}') AND substr(token, 1, 3) NOT IN ('000', '666') AND substr(token, 1, 1) <> '9' AND substr(token, 4, 2) <> '00' AND substr(token, 6, 4) <> '0000'"


@query(f"""WITH base AS (SELECT doc_id, text, {_CASE}, regexp_extract(text, '{NUMBER}') AS token FROM documents WHERE text IS NOT NULL),
placed AS (SELECT *, CASE WHEN token <> '' THEN strpos(text, token) - 1 END AS cp, {_SSN} AS ssn FROM base),
cases AS (SELECT *, {_REASON} AS reason, n = 4 AND method IN ('type-validation', 'reference-differential') AS known, NOT (n = 4) AND method IN ('type-validation', 'reference-differential') AS gone FROM placed),
drafts AS (SELECT *, CASE WHEN reason IS NULL THEN CASE method WHEN 'context-discrimination' THEN id WHEN 'pii-benign' THEN 'sample' WHEN 'jurisdiction-collision' THEN 'collision' WHEN 'mutation' THEN 'mutated' WHEN 'type-validation' THEN 'validated' WHEN 'reference-differential' THEN 'reference' ELSE 'authored' END END AS slot,
  CASE method WHEN 'context-discrimination' THEN head || token || tail WHEN 'mutation' THEN substr(text, 1, cp + length(token) - 1) || CAST((TRY_CAST(right(token, 1) AS INT) + 1) % 10 AS VARCHAR) || substr(text, cp + length(token) + 1) ELSE text END AS made,
  CASE method WHEN 'context-discrimination' THEN strlen(head) ELSE strlen(substr(text, 1, cp)) END AS s FROM ({_SLOTS}))
SELECT case_id, method, reason, slot, CASE WHEN slot IS NOT NULL THEN slot || '-' || substr(sha256({_ID}), 1, 24) END AS variant_id, CASE WHEN slot IS NOT NULL THEN CAST(s AS BIGINT) END AS start, CASE WHEN slot IS NOT NULL THEN CAST(s + strlen(token) AS BIGINT) END AS end_,
  CASE WHEN slot IS NULL THEN NULL WHEN method = 'mutation' AND type_expectation <> 'not-established' THEN 'invalid' ELSE type_expectation END AS type_expectation, CASE WHEN slot IS NOT NULL THEN coalesce(mood, sensitivity) END AS sensitivity, CASE WHEN slot IS NOT NULL THEN coalesce(context, 'neutral') END AS context_class,
  CASE WHEN slot IS NULL THEN NULL WHEN method IN ('context-discrimination', 'mutation') THEN 'derived' WHEN gone THEN 'review-required' ELSE 'authored' END AS strategy,
  CASE WHEN slot IS NULL THEN NULL WHEN method = 'context-discrimination' THEN 'context-frame' WHEN method = 'mutation' THEN 'invalidate-final-digit' WHEN gone THEN 'review-hold' END AS operator,
  CASE WHEN slot IS NOT NULL AND method IN ('context-discrimination', 'mutation') THEN sha256({_SEED}) END AS seed, CASE WHEN slot IS NOT NULL THEN sha256(made) END AS text_digest, CASE WHEN slot IS NOT NULL THEN sha256(text) END AS parent_digest,
  CASE WHEN slot IS NULL THEN NULL WHEN gone THEN CASE method WHEN 'type-validation' THEN 'validator-unavailable' ELSE 'reference-unavailable' END WHEN known AND method = 'reference-differential' AND type_expectation = 'valid' AND NOT ssn THEN 'reference-disagrees' END AS review FROM drafts""")
def assembled_variants(spark: SparkSession, d: str) -> DataFrame:
    """Every document as a case whose candidate is its first number, by all seven methods; some have no number, no validator or bad frames."""
    docs = spark.read.parquet(f"{d}/documents.parquet").where("text is not null").select("doc_id", "text")
    docs = spark.sql(f"SELECT doc_id, text, {_CASE} FROM {{docs}}", docs=docs).withColumn("token", F.regexp_extract("text", NUMBER, 0))
    start = F.when(F.col("token") != "", ranges.byte_of_point(F.col("text"), F.instr("text", F.col("token")) - 1))
    n, frame = F.col("n"), lambda f: F.struct(*[F.lit(x).alias(c) for c, x in zip(("id", "template", "context_class", "sensitivity"), f)])
    a, b, c = FRAMES
    sets = {1: [a, b], 2: [a[:3] + ("non-sensitive",), b, c], 3: [(a[0], "no marker", *a[2:]), b, c], 4: [a, b, ("f-a", *c[1:])]}
    frames = F.array(*map(frame, FRAMES))
    for k, fs in sets.items():
        frames = F.when(n == k, F.array(*map(frame, fs))).otherwise(frames)
    none = F.lit(None).cast("string")
    cases = docs.withColumns(
        {
            "exp_start": start,
            "exp_end": start + F.octet_length("token"),
            "family": F.lit("pii:global:number"),
            "jurisdiction": none,
            "obligation": F.lit(variants.OBLIGED),
            "frames": frames,
            "mutation": F.struct(F.when(n == 4, "other").otherwise(variants.MUTATION[0]).alias("id"), F.when(n == 5, 2).otherwise(1).alias("version")),
            "benign_class": F.when(n == 2, "Not a slug").otherwise("sample"),
            "validator": F.when(n == 4, "us-ssn-allocation").when(n != 3, "nobody"),
            "version": F.lit(1),
            "competing": F.when(n != 1, F.array(F.lit("pii:global:other"))),
            "cross_family": F.lit(False),
            "checks": F.lit(None).cast("array<struct<validator:string,version:int,expected:string>>"),
            "evidence_method": none,
            "evidence_classes": F.lit(None).cast("array<string>"),
        }
    )
    return variants.assembled(cases, RULES).drop("text", "operator_version").withColumnRenamed("end", "end_")


@query(f"""SELECT method, reason, CAST(grouping(method) + grouping(reason) AS BIGINT) AS level, count(DISTINCT case_id) AS cases, count(DISTINCT case_id) FILTER (slot IS NULL) AS refused, count(slot) AS variants
FROM ({SQL["assembled_variants"]}) GROUP BY ROLLUP (method, reason)""")
def generation_totals(spark: SparkSession, d: str) -> DataFrame:
    """Cases, refusals and variants by method and reason, by method, and in all; level counts what is added up."""
    rows = assembled_variants(spark, d).groupBy("case_id", "method", "reason").agg(F.count("slot").alias("variants"))
    tally = [F.count("*").alias("cases"), F.count_if(F.col("variants") == 0).alias("refused"), F.sum("variants").alias("variants")]
    level = (F.grouping("method").cast("long") + F.grouping("reason").cast("long")).alias("level")
    return rows.rollup("method", "reason").agg(level, *tally).select("method", "reason", "level", "cases", "refused", "variants")
