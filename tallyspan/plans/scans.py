"""Queries over findings that detectors make of the documents, each with its SQL. Importing this module registers them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import ranges
from ..operators import matching, scan
from ..sources import staging
from . import sql
from .queries import AXES, query

NUMBER, MAIL, CARD = "[0-9]{3,}", "[A-Za-z0-9._-]+@[A-Za-z0-9-]+[.][A-Za-z]+", "[0-9]{12,19}"
#: What authors expect of a text: numbers with their hyphens.
AUTHORED = "[0-9]+(?:-[0-9]+)+|[0-9]{4,}"
DETECTORS = {0: scan.pattern(NUMBER, "number", True), 1: scan.pattern(MAIL, "email"), 2: scan.luhn(CARD, "card"), 3: scan.flaky(scan.pattern(NUMBER, "number", True), 2)}
REPLAYS = 2


def _matches(pattern: str) -> str:
    """Each match of a pattern in each document, with its number and its range in bytes."""
    at = lambda upto: f"CAST(strlen(array_to_string(parts[1:i], '')) + strlen(array_to_string(runs[1:{upto}], '')) AS BIGINT)"
    return f"""SELECT doc_id, CAST(i - 1 AS BIGINT) AS nth, {at('i - 1')} AS s, {at('i')} AS e, runs[i] AS token FROM (SELECT *, unnest(range(1, len(runs) + 1)) AS i
  FROM (SELECT doc_id, regexp_extract_all(text, '{pattern}') AS runs, regexp_split_to_array(text, '{pattern}') AS parts FROM documents))"""


_LUHN = "list_sum(list_transform(range(1, len(token) + 1), lambda k: CASE WHEN k % 2 = 1 THEN CAST(reverse(token)[k] AS INT) ELSE (2 * CAST(reverse(token)[k] AS INT)) // 10 + (2 * CAST(reverse(token)[k] AS INT)) % 10 END)) % 10 = 0"
_FOUND = f"""number AS ({_matches(NUMBER)}), mail AS ({_matches(MAIL)}), card AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY nth) - 1 AS n FROM ({_matches(CARD)}) WHERE {_LUHN}),
findings AS (SELECT CAST(0 AS BIGINT) AS scanner_id, doc_id AS variant_id, nth AS emission, s AS f_start, e AS f_end, 'number' AS f_family, CAST(NULL AS VARCHAR) AS f_jurisdiction, TRUE AS f_sensitive, CAST(NULL AS VARCHAR) AS f_action FROM number
  UNION ALL SELECT 1, doc_id, nth, s, e, 'email', NULL, NULL, NULL FROM mail UNION ALL SELECT 2, doc_id, n, s, e, 'card', NULL, TRUE, NULL FROM card UNION ALL SELECT 3, doc_id, nth, s, e, 'number', NULL, TRUE, NULL FROM number)"""
_UNSTABLE = "(SELECT count(DISTINCT variant_id) FROM findings WHERE scanner_id = 3 AND emission % 2 = 1)"
_CASES = f"""expectations AS (SELECT doc_id AS case_id, doc_id AS variant_id, nth AS occurrence_id, 'type-validation' AS method, 'en' AS language, CAST(NULL AS VARCHAR) AS jurisdiction, 'number' AS family, 'neutral' AS context_class, FALSE AS text_negative,
  s AS exp_start, e AS exp_end, 'valid' AS type_expectation, 'sensitive' AS sensitivity FROM ({_matches(AUTHORED)})),
scanners AS (SELECT CAST(i AS BIGINT) AS scanner_id, CASE WHEN i = 3 AND {_UNSTABLE} > 0 THEN 'unstable' ELSE 'complete' END AS status, 'supported' AS cap_ranges, 'supported' AS cap_family, 'undeclared' AS cap_jurisdiction, CASE WHEN i = 1 THEN 'undeclared' ELSE 'supported' END AS cap_sensitivity,
  'unavailable' AS cap_action FROM range(4) r(i)),
families AS (SELECT * FROM (VALUES (0, 'number', 'supported'), (1, 'email', 'supported'), (2, 'card', 'supported'), (3, 'number', 'supported')) f(scanner_id, family, state)),
jurisdictions AS (SELECT 0 AS scanner_id, '' AS jurisdiction, '' AS state WHERE FALSE)"""


def _texts(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").alias("variant_id"), "text")


@query(f"WITH {_FOUND} SELECT * FROM findings")
def scanned_findings(spark: SparkSession, d: str) -> DataFrame:
    """What four detectors find in every document: numbers, addresses, card numbers by their check digit, and numbers once more."""
    return scan.scan(_texts(spark, d), DETECTORS, replays=1).drop("replay")


@query(f"WITH {_FOUND} SELECT CAST(i AS BIGINT) AS scanner_id, CASE WHEN i = 3 AND {_UNSTABLE} > 0 THEN 'unstable' ELSE 'complete' END AS status, CASE WHEN i = 3 THEN {_UNSTABLE} ELSE 0 END AS unstable FROM range(4) r(i)")
def scanner_replays(spark: SparkSession, d: str) -> DataFrame:
    """Every detector run twice; the last one misses a finding in two in its second run."""
    return scan.statuses(spark, DETECTORS, scan.scan(_texts(spark, d), DETECTORS, REPLAYS), REPLAYS)


@query(f"WITH {_FOUND}, {_CASES}, " + ", ".join(f"{n} AS ({b})" for n, b in sql.ASSESSED) + f" SELECT {', '.join(AXES)} FROM outcomes")
def scanned_outcomes(spark: SparkSession, d: str) -> DataFrame:
    """Detectors that were run, assessed against numbers as an author marks them; a scanner whose replays differ measured nothing."""
    found = staging.kept(scan.scan(_texts(spark, d), DETECTORS, REPLAYS), "findings")
    status = scan.statuses(spark, DETECTORS, found, REPLAYS).drop("unstable")
    mood = F.when(F.col("scanner_id") == 1, "undeclared").otherwise("supported")
    family = F.element_at(F.array(*map(F.lit, ("number", "email", "card", "number"))), (F.col("scanner_id") + 1).cast("int"))
    fixed = {"cap_ranges": F.lit("supported"), "cap_family": F.lit("supported"), "cap_jurisdiction": F.lit("undeclared"), "cap_sensitivity": mood, "cap_action": F.lit("unavailable")}
    scanners = status.withColumns(fixed | {"families": F.create_map(family, F.lit("supported")), "jurisdictions": F.create_map().cast("map<string,string>")})
    spans = ranges.every_match(_texts(spark, d), "text", AUTHORED).select("variant_id", "start", "end_")
    authored = spans.groupBy("variant_id").agg(F.array_sort(F.collect_list(F.struct("start", "end_"))).alias("x")).select("variant_id", F.posexplode("x").alias("nth", "x"))
    expectations = authored.select(
        F.col("variant_id").alias("case_id"), "variant_id", F.col("nth").cast("long").alias("occurrence_id"), F.lit("type-validation").alias("method"), F.lit("en").alias("language"), F.lit(None).cast("string").alias("jurisdiction"),
        F.lit("number").alias("family"), F.lit("neutral").alias("context_class"), F.lit(False).alias("text_negative"), F.col("x.start").alias("exp_start"), F.col("x.end_").alias("exp_end"), F.lit("valid").alias("type_expectation"), F.lit("sensitive").alias("sensitivity"),
    )
    return matching.assess(expectations, scanners, found.where("replay = 0"), observed=False).select(*AXES)
