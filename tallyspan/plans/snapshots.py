"""Evidence snapshots derived from the given tables, one a nation, and their staged verification with its SQL. Importing this module registers it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import snapshot
from .queries import query

#: Plain SQL that Spark and DuckDB read alike. The nation's remainder n plants a fault in some of its rows; 0 has none.
_S = lambda x: f"CAST({x} AS STRING)"
TABLES = {
    "manifests": "SELECT CAST(n_nationkey AS BIGINT) AS snapshot, n_nationkey % 13 AS n, CASE WHEN n_nationkey % 13 = 1 THEN 'internal' ELSE 'public' END AS population FROM nation",
    "sources": "SELECT CAST(s_nationkey AS BIGINT) AS snapshot, concat('source-', CAST(s_suppkey AS STRING)) AS id, CASE WHEN s_nationkey % 13 = 4 AND s_suppkey % 3 = 0 THEN 'scraped' ELSE 'synthetic' END AS origin FROM supplier",
    "rules": f"SELECT snapshot, concat('rule-', {_S('r_regionkey')}) AS id, 1 + r_regionkey % 2 AS version, CASE WHEN r_regionkey = 4 THEN 'derived' ELSE 'copy' END AS mode FROM manifests CROSS JOIN region",
    "cases": f"""SELECT CAST(c_nationkey AS BIGINT) AS snapshot, c_custkey AS k, c_nationkey % 13 AS n, concat('case-', {_S('c_custkey')}) AS id, 'synthetic' AS origin,
  CASE WHEN c_nationkey % 13 = 5 AND c_custkey % 7 = 0 THEN 'ghost' ELSE lower(c_mktsegment) END AS kind, concat('Größe: ', c_name, '.') AS text, CAST(9 AS BIGINT) AS start, CAST(9 + length(c_name) AS BIGINT) AS e,
  'valid' AS identity, CASE WHEN c_custkey % 2 = 0 THEN 'sensitive' ELSE 'non-sensitive' END AS sensitivity, concat('class-', {_S('c_custkey % 3')}) AS evidence_class FROM customer""",
    "kinds": "SELECT snapshot, id FROM manifests CROSS JOIN (SELECT DISTINCT lower(c_mktsegment) AS id FROM customer)",
    "skips": f"SELECT snapshot, concat(id, '/rule-', {_S('k % 5')}) AS id, id AS case_id, concat('rule-', {_S('CASE WHEN n = 6 AND k % 33 = 0 THEN 9 ELSE k % 5 END')}) AS rule FROM cases WHERE k % 11 = 0",
    "fixtures": f"""SELECT snapshot, k, n, concat(id, '/rule-', {_S('k % 5')}) AS id, id AS case_id, concat('rule-', {_S('k % 5')}) AS rule, 1 + k % 5 % 2 + CASE WHEN n = 8 AND k % 4 = 0 THEN 1 ELSE 0 END AS rule_version, evidence_class,
  concat('> ', text) AS content, CASE WHEN k % 5 <> 4 THEN start + 2 + CASE WHEN n = 12 AND k % 3 = 0 THEN 1 WHEN n = 12 AND k % 3 = 1 THEN -6 ELSE 0 END END AS start, CASE WHEN k % 5 <> 4 THEN e + 2 END AS e,
  CASE WHEN k % 5 = 4 THEN 'not-established' ELSE identity END AS identity, CASE WHEN k % 5 = 4 THEN 'context-dependent' WHEN n = 11 AND k % 3 = 0 THEN 'sensitive' ELSE sensitivity END AS sensitivity, k % 5 = 4 AS derived
FROM cases WHERE k % 11 <> 0 OR n = 7 AND k % 22 = 0""",
}
_SIZED = "SELECT *, {size}(content) + CASE WHEN n = 9 AND k % 6 = 0 THEN 1 ELSE 0 END AS byte_length, {sha} AS sha256 FROM fixtures"
_LINES = "SELECT snapshot, {name} AS path, CAST(sum({size}(id) + 1) AS BIGINT) AS bytes, count(*) AS records FROM {table} GROUP BY snapshot"
_LISTED = "SELECT l.snapshot, l.path, l.bytes + CASE WHEN n = 2 THEN 1 ELSE 0 END AS bytes, l.records + CASE WHEN n = 3 AND path = 'cases' THEN 1 ELSE 0 END AS records FROM present l JOIN manifests m ON l.snapshot = m.snapshot WHERE NOT (n = 10 AND path = 'skips')"
_FILES = ("cases", "fixtures", "skips")


def _present(size: str) -> str:
    return " UNION ALL ".join(_LINES.format(name=f"'{t}'", size=size, table=t) for t in _FILES)


_COUNTS = " UNION ALL ".join(f"SELECT snapshot, '{t}' AS key, count(*) + 0 AS n FROM {t} GROUP BY snapshot" for t in _FILES)

_WITH = ",\n".join(f"{k} AS ({v})" for k, v in TABLES.items())
_SQL = f"""WITH {_WITH}, present AS ({_present('strlen')}), listed AS ({_LISTED}), sized AS ({_SIZED.format(size='strlen', sha="sha256(CASE WHEN n = 9 AND k % 6 = 1 THEN 'other' ELSE content END)")}),
pairs AS (SELECT snapshot, id, case_id, rule FROM fixtures UNION ALL SELECT snapshot, id, case_id, rule FROM skips),
joined AS (SELECT f.*, c.text, c.start AS cs, c.e AS ce, c.identity AS ci, c.sensitivity AS cm, c.evidence_class AS cc, r.version, r.mode, encode(content) AS raw, encode(c.text) AS craw
  FROM sized f JOIN cases c ON c.snapshot = f.snapshot AND c.id = f.case_id JOIN rules r ON r.snapshot = f.snapshot AND r.id = f.rule),
defects AS (SELECT snapshot, 0 AS stage, 'population-not-public' AS code, 'population' AS place FROM manifests WHERE population <> 'public'
  UNION ALL SELECT snapshot, 1, CASE WHEN p.bytes IS NULL THEN 'file-missing' WHEN l.bytes IS NULL THEN 'file-unlisted' WHEN l.bytes <> p.bytes THEN 'file-length-mismatch' ELSE 'record-count-mismatch' END, path
    FROM listed l FULL JOIN present p USING (snapshot, path) WHERE l.bytes IS DISTINCT FROM p.bytes OR l.records IS DISTINCT FROM p.records
  UNION ALL SELECT snapshot, 3, 'source-not-public-safe', id FROM sources WHERE origin NOT IN ('reserved', 'synthetic', 'public-test')
  UNION ALL SELECT snapshot, 4, 'reference-unresolved', id FROM cases c WHERE NOT EXISTS (SELECT 1 FROM kinds k WHERE k.snapshot = c.snapshot AND k.id = c.kind)
  UNION ALL SELECT snapshot, 4, 'reference-unresolved', id FROM skips s WHERE NOT EXISTS (SELECT 1 FROM rules r WHERE r.snapshot = s.snapshot AND r.id = s.rule)
  UNION ALL SELECT snapshot, 4, 'reference-unresolved', id FROM pairs WHERE id <> case_id || '/' || rule
  UNION ALL SELECT snapshot, 4, 'reference-unresolved', max(id) FROM pairs GROUP BY snapshot, case_id, rule HAVING count(*) > 1
  UNION ALL SELECT snapshot, 5, CASE WHEN rule_version <> version OR evidence_class <> cc THEN 'reference-unresolved' WHEN strlen(content) <> byte_length THEN 'fixture-length-mismatch' WHEN sha256(content) <> sha256 THEN 'fixture-digest-mismatch'
    WHEN start IS NOT NULL AND (start >= e OR e > strlen(content) OR ('0x' || substr(hex(raw), CAST(2 * start + 1 AS BIGINT), 2))::INT & 192 = 128) THEN 'span-invalid'
    WHEN CASE mode WHEN 'copy' THEN derived OR identity <> ci OR sensitivity <> cm OR substr(hex(raw), CAST(2 * start + 1 AS BIGINT), CAST(2 * (e - start) AS BIGINT)) IS DISTINCT FROM substr(hex(craw), CAST(2 * cs + 1 AS BIGINT), CAST(2 * (ce - cs) AS BIGINT))
      ELSE NOT derived OR identity <> 'not-established' OR sensitivity <> 'context-dependent' OR start IS NOT NULL END THEN 'fixture-expectation-mismatch' END AS code, id FROM joined),
staged AS (SELECT snapshot, stage, min((code, place)) AS least, count(*) AS n FROM defects WHERE code IS NOT NULL GROUP BY ALL),
firsts AS (SELECT * FROM staged QUALIFY stage = min(stage) OVER (PARTITION BY snapshot))
"""
_STAGE = "['population', 'files', 'counts', 'safety', 'references', 'fixtures'][stage + 1]"


def _tables(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    inputs = [f"{t} AS (SELECT * FROM parquet.`{d}/{t}.parquet`)" for t in ("nation", "region", "supplier", "customer")]
    extra = {"sized": _SIZED.format(size="octet_length", sha="sha2(CASE WHEN n = 9 AND k % 6 = 1 THEN 'other' ELSE content END, 256)"), "present": _present("octet_length"), "listed": _LISTED, "counts": _COUNTS}
    head = "WITH " + ",\n".join([*inputs, *(f"{k} AS ({v})" for k, v in (TABLES | extra).items())])
    read = lambda t: spark.sql(f"{head}\nSELECT * FROM {t}")
    named = {t: read(t).withColumnsRenamed({"case_id": "case", "e": "end"}) for t in ("manifests", "sources", "rules", "cases", "kinds", "skips", "sized", "present", "listed", "counts")}
    return named | {"fixtures": named["sized"]}


def _defects(spark: SparkSession, d: str) -> tuple[DataFrame, list[DataFrame]]:
    t = _tables(spark, d)
    found = [
        snapshot.manifest_defects(t["manifests"]),
        snapshot.file_defects(t["listed"], t["present"]),
        snapshot.count_defects(t["counts"], {k: t[k] for k in _FILES}),
        snapshot.safety_defects(t["sources"]),
        snapshot.reference_defects(t["cases"], "id", F.col("kind"), t["kinds"]),
        snapshot.reference_defects(t["skips"], "id", F.col("rule"), t["rules"]),
        snapshot.pair_defects(t["fixtures"], t["skips"]),
        snapshot.fixture_defects(t["fixtures"], t["cases"], t["rules"]),
    ]
    return t["manifests"], found


@query(_SQL + f"SELECT m.snapshot, {_STAGE} AS stage, least[1] AS code, least[2] AS place, coalesce(f.n, 0) AS defects FROM manifests m LEFT JOIN firsts f ON m.snapshot = f.snapshot")
def snapshot_failures(spark: SparkSession, d: str) -> DataFrame:
    """The first failing stage of each nation's snapshot."""
    return snapshot.first_failures(*_defects(spark, d))


@query(_SQL + f"SELECT snapshot, {_STAGE} AS stage, code, place FROM defects WHERE code IS NOT NULL AND stage = 5")
def fixture_agreement(spark: SparkSession, d: str) -> DataFrame:
    """Fixtures that disagree with their case or rule, in whatever stage their snapshot fails."""
    rows = _defects(spark, d)[1][-1]
    return rows.withColumn("stage", F.lit("fixtures"))


@query(_SQL + """SELECT k.snapshot, k.id AS kind, count(c.id) AS cases, CAST(coalesce(sum(f.made), 0) AS BIGINT) AS fixtures FROM kinds k LEFT JOIN cases c ON c.snapshot = k.snapshot AND c.kind = k.id
LEFT JOIN (SELECT snapshot, case_id, count(*) AS made FROM fixtures GROUP BY ALL) f ON f.snapshot = c.snapshot AND f.case_id = c.id GROUP BY ALL""")
def kind_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Cases and fixtures of each kind of each snapshot, with the kinds that have none."""
    t = _tables(spark, d)
    return snapshot.coverage(t["kinds"], t["cases"], t["fixtures"])
