"""Queries over bindings, records, generation runs and the older accounting, each with its SQL. Importing this module registers them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import identity, records
from ..operators import bindings, compare, generate, legacy, matching, normalize, verify
from ..sources import documents, staging
from . import sql
from .products import _FIELD
from .queries import AXES, KEYS, WITHIN, Of, query

def _orders(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/orders.parquet")


_ODD = "CASE o_orderkey % 3 WHEN 0 THEN 'plain' WHEN 1 THEN 'say \"a\\b\"' ELSE 'tab' || chr(9) || 'line' || chr(10) || 'é' END"
_JSON_TEXT = "replace(replace(replace(replace(name, '\\', '\\\\'), '\"', '\\\"'), chr(9), '\\u0009'), chr(10), '\\u000a')"
_CANONICAL = f"""'{{"active":' || CASE WHEN o_orderkey % 2 = 0 THEN 'true' ELSE 'false' END || ',"count":' || o_custkey || ',"name":"' || {_JSON_TEXT} || '","tags":["t' || o_orderkey % 5 || '","t' || o_orderkey % 7 || '"]}}'"""


@query(f"""SELECT o_orderkey, canonical, sha256('canonical' || chr(10) || 'document' || chr(10) || canonical) AS digest
FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 11 <> 0 THEN {_CANONICAL} END AS canonical FROM (SELECT *, {_ODD} AS name FROM orders))""")
def semantic_digests(spark: SparkSession, d: str) -> DataFrame:
    """Some records hold a null in their tags and have no digest."""
    odd = F.when(F.col("o_orderkey") % 3 == 0, "plain").when(F.col("o_orderkey") % 3 == 1, 'say "a\\b"').otherwise("tab\tline\né")
    tag = lambda n: F.concat(F.lit("t"), F.col("o_orderkey") % n)
    record = F.struct(F.array(tag(5), F.when(F.col("o_orderkey") % 11 != 0, tag(7))).alias("tags"), odd.alias("name"), F.col("o_custkey").cast("long").alias("count"), (F.col("o_orderkey") % 2 == 0).alias("active"))
    rows = _orders(spark, d).select("o_orderkey", record.alias("record"))
    rows = rows.select("o_orderkey", records.canonical(F.col("record"), rows.schema["record"].dataType).alias("canonical"))
    return rows.withColumn("digest", records.semantic_digest("canonical", "document", F.col("canonical")))


#: A table's digest as ``staging.digest`` gives it.
_CELLS = " || ".join(_FIELD.format(f"coalesce('=' || CAST({c} AS VARCHAR), '~')") for c in sorted(AXES))
_SUMS = " || ',' || ".join(f"CAST(sum(CAST('0x' || substr(h, {i * staging.LIMB + 1}, {staging.LIMB}) AS BIGINT)) AS VARCHAR)" for i in range(staging.LIMBS))


def _digest_sql(run: str, rows: str) -> str:
    return f"SELECT '{run}' AS run, count(*) AS rows, sha256(CAST(count(*) AS VARCHAR) || ',' || {_SUMS}) AS digest FROM (SELECT sha256({_CELLS}) AS h FROM ({rows}))"


_CHANGED = "CASE WHEN case_id % 997 = 1 AND scanner_id = 0 THEN 'not-measured' ELSE type_state END"


@query(sql.ask(_digest_sql("first", "SELECT * FROM outcomes") + " UNION ALL " + _digest_sql("replayed", "SELECT * FROM outcomes") + " UNION ALL " + _digest_sql("changed", f"SELECT * REPLACE ({_CHANGED} AS type_state) FROM outcomes"), sql.ASSESSED))
def replay_equality(spark: SparkSession, d: str) -> DataFrame:
    """Digests of an assessment, of one rebuilt from observations that were published and read back, and of one with planted changes."""
    p = Of(spark, d)
    path = staging.place(spark, "observations")
    staging.publish(p.findings, path)
    again = matching.assess(p.expectations, p.scanners, spark.read.parquet(path), False, WITHIN).select(*AXES)
    # the changed table is the first but for few rows, so both are digested in one pass
    differs = ~F.expr(_CHANGED).eqNullSafe(F.col("type_state"))
    first = p.outcomes().select(*AXES).withColumn("tag", F.explode(F.when(differs, F.array(F.lit("before"), F.lit("after"))).otherwise(F.array(F.lit("both")))))
    first = first.withColumn("type_state", F.when(F.col("tag") == "after", F.expr(_CHANGED)).otherwise(F.col("type_state")))
    told = staging.digests(first, "tag", {"first": ("both", "before"), "changed": ("both", "after")})
    return told.union(staging.digest(again).select(F.lit("replayed").alias("run"), "rows", "digest"))


_JOB = " || ".join(_FIELD.format(f) for f in ("'jobs'", "CAST(o_custkey AS VARCHAR)", "o_orderstatus", "'1'"))


@query(f"SELECT o_orderkey, sha256({_JOB}) AS job, CASE WHEN o_orderkey % 3 <> 0 THEN 's.' || o_orderkey END AS seed FROM orders")
def job_digests(spark: SparkSession, d: str) -> DataFrame:
    job = records.job_digest("jobs", F.col("o_custkey"), F.col("o_orderstatus"), F.lit(1))
    seed = F.concat(F.lit("s"), F.when(F.col("o_orderkey") % 3 == 0, " ").otherwise("/"), F.col("o_orderkey"))
    return _orders(spark, d).select("o_orderkey", job.alias("job"), records.dotted_seed(seed).alias("seed"))


_PREIMAGE = " || ".join(_FIELD.format(f) for f in ("'case-' || o_orderkey", "'authored'"))


@query(f"SELECT o_orderkey, 'authored-' || substr(sha256({_PREIMAGE}), 1, 24) AS variant_id, hex({_PREIMAGE}) AS preimage FROM orders")
def variant_ids(spark: SparkSession, d: str) -> DataFrame:
    k = F.concat(F.lit("case-"), F.col("o_orderkey"))
    return _orders(spark, d).select("o_orderkey", identity.variant_id(k, F.lit("authored")).alias("variant_id"), F.hex(identity.preimage(k, F.lit("authored"))).alias("preimage"))


@query("""SELECT o_orderkey, CASE WHEN ms BETWEEN 0 AND 253402300799999 THEN strftime(make_timestamp(ms * 1000), '%Y-%m-%dT%H:%M:%S.%gZ') ELSE '1970-01-01T00:00:00.000Z' END AS stamp,
  CASE WHEN ms BETWEEN 0 AND 253402300799999 THEN ms ELSE 0 END AS millis, CAST(NULL AS BIGINT) AS none
FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 13 = 0 THEN -1 WHEN o_orderkey % 17 = 0 THEN 253402300800000 ELSE CAST(o_orderkey AS BIGINT) * 86399123 END AS ms FROM orders)""")
def civil_timestamps(spark: SparkSession, d: str) -> DataFrame:
    """Times as text and back; a day that no month has is none."""
    millis = F.when(F.col("o_orderkey") % 13 == 0, -1).when(F.col("o_orderkey") % 17 == 0, 253402300800000).otherwise(F.col("o_orderkey").cast("long") * 86399123)
    rows = _orders(spark, d).select("o_orderkey", records.civil_timestamp(millis).alias("stamp"))
    none = F.concat(F.lit("2023-02-30T00:00:00"), F.when(F.col("o_orderkey") % 2 == 0, ".000").otherwise(""), F.lit("Z"))
    return rows.withColumn("millis", records.unix_millis(F.col("stamp"))).withColumn("none", records.unix_millis(none))


@query("""SELECT o_orderkey, CASE WHEN n IN (0, 4) THEN 'not-a-command' WHEN n IN (1, 5, 6) THEN 'malformed' ELSE 'run' END AS kind, CASE n WHEN 3 THEN 'p-' || o_custkey END AS profile
FROM (SELECT *, o_orderkey % 7 AS n FROM orders)""")
def comment_commands(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("o_orderkey") % 7
    first = F.when(n == 0, "please run").when(n == 1, "/measure run  twice").when(n == 2, "/measure run").when(n == 4, " /measure run").when(n == 5, "/measure").when(n == 6, "/measure run Upper")
    first = first.otherwise(F.concat(F.lit("/measure run p-"), F.col("o_custkey")))
    body = F.concat(first, F.when(F.col("o_orderkey") % 2 == 0, "\r\n/measure run other").otherwise(""))
    return _orders(spark, d).select("o_orderkey", records.command(body, "/measure").alias("x")).select("o_orderkey", "x.kind", "x.profile")


_EVIDENCE = ["near-miss", "cross-family-collision", "reserved-documentation", "official-test", "public-identifier", "ordinary-reference-account", "placeholder", "context-negative", "unknown"]
_CLASS_OF = {"official-test": "test-value", "public-identifier": "public-operational", "ordinary-reference-account": "public-operational", "placeholder": "placeholder", "context-negative": "context-negative"}


@query(f"""SELECT evidence, count(*) AS n, CASE evidence WHEN 'unknown' THEN NULL WHEN 'near-miss' THEN 'type-validation' WHEN 'cross-family-collision' THEN 'jurisdiction-collision' ELSE 'pii-benign' END AS method,
  CASE evidence WHEN 'unknown' THEN NULL WHEN 'reserved-documentation' THEN 'reserved,documentation' {' '.join(f"WHEN '{e}' THEN '{c}'" for e, c in _CLASS_OF.items())} ELSE '' END AS classes
FROM (SELECT {_EVIDENCE!r}[1 + o_orderkey % {len(_EVIDENCE)}] AS evidence FROM orders) GROUP BY ALL""")
def evidence_classes(spark: SparkSession, d: str) -> DataFrame:
    evidence = F.element_at(F.array(*map(F.lit, _EVIDENCE)), (F.col("o_orderkey") % len(_EVIDENCE) + 1).cast("int"))
    rows = _orders(spark, d).groupBy(evidence.alias("evidence")).agg(F.count("*").alias("n"))
    return rows.select("evidence", "n", records.evidence_method(F.col("evidence")).alias("method"), F.array_join(records.accounting_classes(F.col("evidence")), ",").alias("classes"))


_SAW = "FROM (SELECT DISTINCT scanner_id, variant_id, case_id FROM findings)"


@query(sql.ask(f"""SELECT scanner_id, variant_id, CASE WHEN case_id % 13 = 0 THEN 'unknown-variant' ELSE 'input-digest-mismatch' END AS code {_SAW} WHERE case_id % 13 = 0 OR case_id % 11 = 0
UNION ALL SELECT scanner_id, NULL, 'observation-incomplete' FROM scanners WHERE status = 'complete' AND (SELECT count(DISTINCT variant_id) FROM variants WHERE case_id % 13 <> 0)
  > (SELECT count(*) {_SAW} s WHERE s.scanner_id = scanners.scanner_id AND case_id % 13 <> 0)""", ()))
def input_binding_defects(spark: SparkSession, d: str) -> DataFrame:
    """Inputs whose texts have changed, against a snapshot that lacks some cases; no scanner has findings in every variant."""
    p = Of(spark, d)
    text = F.concat(F.lit("text-"), F.col("variant_id"))
    inputs = p.findings.select("scanner_id", "variant_id", "case_id").distinct()
    inputs = inputs.withColumn("input_digest", F.sha2(F.when(F.col("case_id") % 11 == 0, "other").otherwise(text), 256)).drop("case_id")
    variants = p.variants.where("case_id % 13 <> 0").select("variant_id", F.sha2(text, 256).alias("text_digest"))
    return bindings.input_defects(p.scanners, inputs, variants)


@query(sql.ask("""SELECT scanner_id, CASE WHEN e.status IS NULL THEN 'unknown-scanner' ELSE 'configuration-binding-mismatch' END AS code FROM later l FULL JOIN earlier e USING (scanner_id)
WHERE (l.status, l.cap_family, l.cap_sensitivity, l.version) IS DISTINCT FROM (e.status, e.cap_family, e.cap_sensitivity, e.version)""", ()))
def scanner_binding_defects(spark: SparkSession, d: str) -> DataFrame:
    """A run's scanners against those of the plan that an earlier run followed."""
    p = Of(spark, d)
    return bindings.scanner_defects(p.later, p.earlier, ["status", "cap_family", "cap_sensitivity", "version"])


@query(sql.ask("""SELECT 'languages' AS path, 'scope-violation' AS code WHERE EXISTS (SELECT 1 FROM cases WHERE language NOT IN ('en', 'ko'))
UNION ALL SELECT 'jurisdictions', 'scope-violation' WHERE EXISTS (SELECT 1 FROM cases WHERE jurisdiction NOT IN ('US', 'GB'))
UNION ALL SELECT 'methods', 'protocol-binding-mismatch' WHERE EXISTS (SELECT 1 FROM cases WHERE method NOT IN ('type-validation', 'mutation'))""", ()))
def plan_scope_defects(spark: SparkSession, d: str) -> DataFrame:
    return bindings.scope_defects(Of(spark, d).cases, ["en", "ko"], ["US", "GB"], ["type-validation", "mutation"])


@query(sql.ask("""SELECT string_agg(DISTINCT method, ',' ORDER BY method) AS methods, string_agg(DISTINCT language, ',' ORDER BY language) AS languages, string_agg(DISTINCT jurisdiction, ',' ORDER BY jurisdiction) AS jurisdictions,
  (SELECT string_agg(DISTINCT s, ',' ORDER BY s) FROM (SELECT 'pii:' || lower(coalesce(jurisdiction, 'global')) AS s FROM cases UNION ALL SELECT 'pii:global')) AS selectors FROM cases""", ()))
def plan_manifest(spark: SparkSession, d: str) -> DataFrame:
    row = bindings.plan(Of(spark, d).cases)
    return row.select(*[F.array_join(c, ",").alias(c) for c in row.columns])


@query(sql.ask("SELECT e.scanner_id AS base_id, l.scanner_id AS other_id, 'by-id-intersection' AS pairing FROM earlier e JOIN later l USING (scanner_id)", ()))
def scanner_pairs(spark: SparkSession, d: str) -> DataFrame:
    p = Of(spark, d)
    return bindings.pairing(p.earlier, p.later)


_RUN = "SELECT 'internal' AS kind, false AS legacy, count(DISTINCT method) AS protocol, 'public' AS run_class, count(*) AS population, min(case_id) AS mechanics FROM cases"


@query(sql.ask(f"""SELECT CASE c WHEN 'protocol' THEN 'protocol-differs' WHEN 'population' THEN 'population-differs' WHEN 'mechanics' THEN 'mechanics-differs' END AS refusal
FROM (SELECT unnest([CASE WHEN a.protocol <> b.protocol THEN 'protocol' END, CASE WHEN a.population <> b.population THEN 'population' END, CASE WHEN a.mechanics <> b.mechanics THEN 'mechanics' END]) AS c
  FROM ({_RUN}) a, ({_RUN} WHERE case_id % 7 <> 1) b) WHERE c IS NOT NULL
UNION ALL SELECT 'legacy-protocol-revision' UNION ALL SELECT 'scanner-sets-not-pairable'""", ()))
def comparison_refusals(spark: SparkSession, d: str) -> DataFrame:
    """A run and one of fewer cases under an older protocol, with scanners that can't be paired."""
    p = Of(spark, d)

    def run(cases: DataFrame, older: bool) -> DataFrame:
        sizes = [F.countDistinct("method").alias("protocol"), F.count("*").alias("population"), F.min("case_id").alias("mechanics")]
        return cases.agg(*sizes).select("*", F.lit("internal").alias("kind"), F.lit(older).alias("legacy"), F.lit("public").alias("run_class"))

    pairs = bindings.pairing(p.scanners.where("scanner_id < 2"), p.scanners.where("scanner_id >= 2"))
    return bindings.refusals(run(p.cases, False), run(p.cases.where("case_id % 7 <> 1"), True), pairs)


@query("""SELECT 'pin-' || n_nationkey AS label, n_nationkey AS population, CASE WHEN name IS NULL THEN 'missing' ELSE 'accepted' END AS status, name
FROM nation LEFT JOIN (SELECT c_nationkey, min('artifact-' || c_custkey) AS name FROM customer WHERE c_custkey % 2 = 0 AND c_nationkey % 4 <> 0 GROUP BY ALL) ON c_nationkey = n_nationkey""")
def accepted_artifacts(spark: SparkSession, d: str) -> DataFrame:
    read = lambda t: spark.read.parquet(f"{d}/{t}.parquet")
    pins = read("nation").select(F.concat(F.lit("pin-"), "n_nationkey").alias("label"), F.col("n_nationkey").alias("population"))
    reason = F.when(F.expr("c_custkey % 2 = 1 or c_nationkey % 4 = 0"), "metric-mismatch")
    return bindings.accepted(pins, read("customer").select(F.concat(F.lit("artifact-"), "c_custkey").alias("name"), F.col("c_nationkey").alias("population"), reason.alias("reason")))


@query(sql.ask("SELECT path, 'scope-violation' AS code, (SELECT count(*) FROM cases WHERE jurisdiction = 'GB') > 64 AS truncated FROM (SELECT 'cases/' || lpad(case_id::VARCHAR, 12, '0') AS path FROM cases WHERE jurisdiction = 'GB') ORDER BY path LIMIT 64", ()))
def first_violations(spark: SparkSession, d: str) -> DataFrame:
    """A report names 64 violations at most."""
    path = F.concat(F.lit("cases/"), F.lpad(F.col("case_id").cast("string"), 12, "0"))
    return bindings.first_violations(Of(spark, d).cases.where("jurisdiction = 'GB'").select(path.alias("path"), F.lit("scope-violation").alias("code")))


@query(sql.ask(f"SELECT {', '.join(bindings.PUBLIC)} FROM outcomes", sql.ASSESSED))
def public_outcomes(spark: SparkSession, d: str) -> DataFrame:
    return bindings.published_rows(Of(spark, d).outcomes(), F.lit("public-synthetic"))


_WORDS = [(0, "mail", "finding", "email", None), (0, "tel", "finding", "phone", "US"), (0, "noise", "skip", None, None), (0, "ghost", "finding", "iban", None), (1, "mail", "finding", "email", "FR"), (1, "tel", "finding", "phone", None), (1, "noise", "skip", None, None)]
_DECLARED = [(0, ["email", "phone"], ["US"]), (1, ["email", "phone"], ["US"])]
_LABEL = "CASE WHEN (doc_id + i) % 23 = 0 THEN 'ghost' WHEN (doc_id + i) % 19 = 0 THEN 'mail' WHEN (doc_id + i) % 3 = 0 THEN 'noise' WHEN doc_id % 2 = 1 THEN 'tel' ELSE 'mail' END"
_WORD_SQL = ", ".join("(" + ", ".join("NULL" if x is None else repr(x) for x in w) + ")" for w in _WORDS)
_NATIVE = f"SELECT doc_id % 2 AS scanner_id, doc_id AS variant_id, i AS position, {_LABEL} AS label, text, doc_id % 60 + i * 3 AS s, doc_id % 60 + i * 3 + 1 + doc_id % 5 AS e FROM documents, (SELECT unnest(range(4)) AS i) WHERE i < 3 OR doc_id % 29 = 0"
#: For each unit the byte offset of an offset, null where there is none.
_WIDE = "length(regexp_replace(left(text, CAST(k AS BIGINT)), '[\\x{0}-\\x{FFFF}]', '', 'g'))"
_BYTE_OF = {
    "points": "CASE WHEN @ <= length(text) THEN strlen(substr(text, 1, @)) END",
    "bytes": "CASE WHEN @ <= strlen(text) THEN @ END",
    "utf16": f"strlen(left(text, CAST(list_filter(range(0, least(@, length(text)) + 1), lambda k: k + {_WIDE} = @)[1] AS BIGINT)))",
}


def _normalized(unit: str) -> str:
    spans = f"SELECT *, CAST({_BYTE_OF[unit].replace('@', 's')} AS BIGINT) AS f_start, CAST({_BYTE_OF[unit].replace('@', 'e')} AS BIGINT) AS f_end FROM ({_NATIVE})"
    inside = lambda at: "(CASE WHEN {0} < strlen(text) THEN ('0x' || substr(hex(encode(text)), 2 * {0} + 1, 2))::INT & 192 ELSE 0 END) <> 128".format(at)
    coded = f"""SELECT n.*, w.verdict, w.family, w.jurisdiction, CASE WHEN verdict IS NULL THEN 'unmapped-label' WHEN verdict = 'finding' THEN
  CASE WHEN family NOT IN ('email', 'phone') OR coalesce(w.jurisdiction <> 'US', FALSE) THEN 'undeclared' WHEN NOT coalesce(f_start < f_end AND {inside("f_start")} AND {inside("f_end")}, FALSE) THEN 'invalid-range' END END AS code
FROM ({spans}) n LEFT JOIN (VALUES {_WORD_SQL}) w(scanner_id, label, verdict, family, jurisdiction) USING (scanner_id, label)"""
    judged = """SELECT *, CASE WHEN count(*) OVER i > 3 THEN 'output-limit' WHEN bool_or(code = 'unmapped-label') OVER i THEN 'unmapped-label' ELSE arg_min(code, position) FILTER (code IN ('undeclared', 'invalid-range')) OVER i END AS failure
FROM coded WINDOW i AS (PARTITION BY scanner_id, variant_id)"""
    return f"WITH coded AS ({coded}), judged AS ({judged}) "


def _mapped(spark: SparkSession, d: str, unit: str) -> DataFrame:
    docs = spark.read.parquet(f"{d}/documents.parquet")
    last = F.when(F.col("doc_id") % 29 == 0, 3).otherwise(2)
    rows = docs.select("doc_id", F.explode(F.sequence(F.lit(0), last)).alias("i"))
    start = F.col("doc_id") % 60 + F.col("i") * 3
    native = rows.select((F.col("doc_id") % 2).alias("scanner_id"), F.col("doc_id").alias("variant_id"), F.col("i").cast("long").alias("position"), F.expr(_LABEL).alias("label"), start.alias("start"), (start + 1 + F.col("doc_id") % 5).alias("end_"))
    words = spark.createDataFrame(_WORDS, "scanner_id long, label string, verdict string, family string, jurisdiction string")
    declared = spark.createDataFrame(_DECLARED, "scanner_id long, families array<string>, jurisdictions array<string>")
    return normalize.mapped(native, docs.select(F.col("doc_id").alias("variant_id"), "text"), words, declared, unit, 3)


def _normalized_findings(unit: str, name: str) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        return normalize.findings(_mapped(spark, d, unit))

    run.__name__ = name
    run.__doc__ = f"Labels that skip, that no vocabulary has and that go beyond what is declared; offsets in {unit}, some beyond the text."
    query(_normalized(unit) + "SELECT scanner_id, variant_id, position, f_start, f_end, family, jurisdiction FROM judged WHERE failure IS NULL AND verdict = 'finding'")(run)


for _unit, _name in (("points", "normalized_findings"), ("utf16", "normalized_findings_utf16"), ("bytes", "normalized_findings_bytes")):
    _normalized_findings(_unit, _name)


@query(_normalized("points") + "SELECT scanner_id, variant_id, min(failure) AS failure, count(*) FILTER (failure IS NULL AND verdict = 'finding') AS findings, count(*) FILTER (failure IS NULL AND verdict = 'skip') AS skipped FROM judged GROUP BY ALL")
def normalized_inputs(spark: SparkSession, d: str) -> DataFrame:
    return normalize.summary(_mapped(spark, d, "points"))


def _results(p: Of) -> DataFrame:
    variants = F.when(F.col("case_id") % 9 == 0, 0).when(F.col("method") == "context-discrimination", 3).otherwise(1)
    rows = p.cases.select("case_id", "method", variants.alias("variants"))
    return rows.union(rows.where("case_id % 71 = 0"))


_RESULTS = ("results", "SELECT case_id, method, CASE WHEN case_id % 9 = 0 THEN 0 WHEN method = 'context-discrimination' THEN 3 ELSE 1 END AS variants FROM (SELECT * FROM cases UNION ALL SELECT * FROM cases WHERE case_id % 71 = 0)")


@query(sql.ask("""SELECT 'run' AS subject, 'limit-cases' AS code FROM results HAVING count(*) > 100 UNION ALL SELECT 'run', 'limit-total-variants' FROM results HAVING sum(variants) > 1000000000
UNION ALL SELECT method, 'limit-variants-per-method' FROM results GROUP BY method HAVING sum(variants) > 250 UNION ALL SELECT CAST(case_id AS VARCHAR), 'duplicate-case' FROM results GROUP BY case_id HAVING count(*) > 1""", (_RESULTS,)))
def generation_run_defects(spark: SparkSession, d: str) -> DataFrame:
    return generate.run_defects(_results(Of(spark, d)), most_cases=100, most_of_method=250, most_variants=1_000_000_000)


@query(sql.ask("""SELECT s.case_id, s.units, b.batch FROM sums s JOIN begins b ON s.rn >= b.rn AND s.rn < b.nxt""", (
    _RESULTS,
    ("weights", "SELECT DISTINCT case_id, CAST(greatest(variants, 1) AS BIGINT) AS units FROM results"),
    ("sums", "SELECT case_id, units, row_number() OVER o AS rn, CAST(sum(units) OVER o AS BIGINT) AS total FROM weights WINDOW o AS (ORDER BY case_id)"),
    ("links", "SELECT a.rn, coalesce(b.rn, (SELECT max(rn) + 1 FROM sums)) AS nxt FROM sums a ASOF LEFT JOIN (SELECT rn, total FROM sums) b ON a.total - a.units + 64 < b.total"),
    ("begins", "SELECT CAST(1 AS BIGINT) AS rn, (SELECT nxt FROM links WHERE rn = 1) AS nxt, CAST(0 AS BIGINT) AS batch UNION ALL SELECT l.rn, l.nxt, b.batch + 1 FROM begins b JOIN links l ON l.rn = b.nxt"),
)).replace("WITH cases", "WITH RECURSIVE cases", 1))
def generation_batches(spark: SparkSession, d: str) -> DataFrame:
    """The whole run in batches of 64 variants and refusals."""
    return generate.batches(_results(Of(spark, d)).dropDuplicates(["case_id"]), most_units=64)


@query(sql.ask("""SELECT method, version, count(*) AS cases, runtime_evidence FROM cases JOIN (VALUES ('type-validation', 2, TRUE), ('context-discrimination', 2, TRUE), ('pii-benign', 3, TRUE), ('jurisdiction-collision', 3, TRUE),
  ('mutation', 1, TRUE), ('reference-differential', 1, TRUE), ('schema-only', 1, FALSE)) m(method, version, runtime_evidence) USING (method) GROUP BY ALL""", ()))
def method_specs(spark: SparkSession, d: str) -> DataFrame:
    known = Of(spark, d).cases.groupBy("method").agg(F.count("*").alias("cases"))
    return known.join(generate.methods(spark), "method").select("method", "version", "cases", "runtime_evidence")


@query(sql.ask("""SELECT scanner_id, metric, 'overall' AS stratum, label, numerator, measured, CASE WHEN label IN ('Rate A', 'shared') THEN 'label-invalid' WHEN measured > 900 THEN 'roster-violation' END AS code
FROM tallied JOIN (VALUES ('type-miss-rate', 'missed'), ('wrong-family-rate', 'Rate A'), ('sensitive-miss-rate', 'shared'), ('non-sensitive-flag-rate', 'shared')) l(metric, label) USING (metric) WHERE stratum = 'overall'"""))
def custodian_cells(spark: SparkSession, d: str) -> DataFrame:
    labels = [("type-miss-rate", "missed"), ("wrong-family-rate", "Rate A"), ("sensitive-miss-rate", "shared"), ("non-sensitive-flag-rate", "shared")]
    return verify.custodian_cells(Of(spark, d).metrics().where("stratum = 'overall'"), spark.createDataFrame(labels, "metric string, label string"), 900)


@query("SELECT c_custkey, c_custkey % 7 >= 1 AND c_custkey % 5 >= 2 AND c_custkey % 11 > 0 AND (c_custkey % 11 <> 10) AND c_custkey % 14 BETWEEN 1 AND 12 AS valid FROM customer")
def mechanics_checks(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    z = (k % 11).cast("long")
    return spark.read.parquet(f"{d}/customer.parquet").select("c_custkey", verify.mechanics_valid(k % 7, k % 5, z, F.lit(2), k % 14).alias("valid"))


@query("""SELECT l_returnflag AS k, round(median(CAST(l_extendedprice AS DOUBLE) / l_linenumber), 3) AS median, round(max(CAST(l_extendedprice AS DOUBLE) / l_linenumber), 3) AS ceiling FROM lineitem GROUP BY ALL""")
def budget_envelope(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.read.parquet(f"{d}/lineitem.parquet").select(F.col("l_returnflag").alias("k"), (F.col("l_extendedprice").cast("double") / F.col("l_linenumber")).alias("cost"))
    return compare.trials(rows, "k", "cost").select("k", F.round("median", 3).alias("median"), F.round("most", 3).alias("ceiling"))


#: A conversation turn as a line, plain SQL that Spark and DuckDB read alike: some repeat the id before them, some are broken.
_ID = "concat(lpad(CAST(conv_id AS STRING), 10, '0'), '-', lpad(CAST(turn - CASE WHEN conv_id % 9 = 0 AND turn = 2 THEN 1 ELSE 0 END AS STRING), 6, '0'))"
_LINE = f"CASE WHEN conv_id % 31 = 0 AND turn = 1 THEN concat('{{broken ', CAST(conv_id AS STRING)) ELSE concat('{{\"id\":\"', {_ID}, '\"}}') END"


@query(f"""SELECT file_no, sha256(line) AS line_sha256, CASE WHEN id IS NULL THEN 'record-invalid' WHEN before >= id THEN 'id-order-invalid' END AS code
FROM (SELECT *, last_value(id IGNORE NULLS) OVER (PARTITION BY file_no ORDER BY conv_id, turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before
  FROM (SELECT conv_id, turn, CAST(conv_id % 4 AS BIGINT) AS file_no, {_LINE} AS line, CASE WHEN conv_id % 31 = 0 AND turn = 1 THEN NULL ELSE {_ID} END AS id FROM conversations))""")
def hashed_lines(spark: SparkSession, d: str) -> DataFrame:
    """Conversations as four JSON Lines files of one record a turn, written to the shared folder and read back split by split."""
    folder = staging.place(spark, "lines")
    rows = spark.read.parquet(f"{d}/conversations.parquet").select((F.col("conv_id") % 4).alias("file_no"), "conv_id", "turn", F.expr(_LINE).alias("value"))
    rows.repartition("file_no").sortWithinPartitions("file_no", "conv_id", "turn").select("value", "file_no").write.partitionBy("file_no").text(folder)
    lines = documents.json_lines(spark, f"{folder}/*/*.txt", "id string")
    return lines.select(F.regexp_extract("file", "file_no=([0-9]+)", 1).cast("long").alias("file_no"), "line_sha256", "code")


_LROWS = ("lrows", "SELECT *, type_expectation = 'valid' AS v, row_number() OVER (PARTITION BY scanner_id, case_id ORDER BY variant_id, occurrence_id) = 1 AS lead FROM outcomes WHERE exp_start IS NOT NULL")


def _lb(given: str, looked: str, state: str, event: str, every: bool = False) -> str:
    n = lambda test: f"count(*) FILTER ({looked} AND {test})"
    passes = f"{n(f'NOT ({event})')} = 0" if every else f"{n(event)} > 0"
    return f"CASE WHEN NOT ({given}) OR {n('TRUE')} = 0 THEN 'not-applicable' WHEN {n(state + ' = ' + repr('unresolved'))} > 0 THEN 'unresolved' WHEN {n(state + ' = ' + repr('not-measured'))} > 0 THEN 'not-measured' WHEN {passes} THEN 'numerator' ELSE 'other' END"


def _lrange(given: str, looked: str) -> str:
    n = lambda test: f"count(*) FILTER ({looked} AND {test})"
    return f"CASE WHEN NOT ({given}) OR {n('range_state <> ' + repr('miss'))} = 0 THEN 'not-applicable' WHEN {n('range_state = ' + repr('not-applicable'))} > 0 THEN 'not-measured' WHEN {n('range_state IN ' + repr(('overbroad', 'partial')))} > 0 THEN 'numerator' ELSE 'other' END"


def _lshare(state: str, open_too: str = "FALSE") -> str:
    return f"CASE WHEN bool_or({open_too} OR {state} = 'unresolved') THEN 'unresolved' WHEN bool_or({state} = 'not-measured') THEN 'not-measured' ELSE 'numerator' END"


_LEAD, _PLACE = "bool_or(lead AND v)", "bool_or(lead AND jurisdiction IS NOT NULL)"
_LENDS = "context_class <> 'neutral'"
_LSTANDS = [
    *[(m, 1, on, _lb(f"{g} AND {_LEAD}" if on else g, "TRUE" if on else "v", "type_state", f"type_state = '{s}'")) for m, s, g in (("type-miss-rate", "miss", "TRUE"), ("wrong-family-rate", "wrong-family", "TRUE"), ("wrong-jurisdiction-rate", "wrong-jurisdiction", _PLACE)) for on in (False, True)],
    ("range-collateral-rate", 1, False, _lrange("TRUE", "v")),
    ("range-collateral-rate", 1, True, _lrange(_LEAD, "TRUE")),
    ("sensitive-miss-rate", 0, False, _lb("TRUE", "sensitivity = 'sensitive'", "sensitivity_state", "sensitivity_state = 'miss'")),
    ("non-sensitive-flag-rate", 0, False, _lb("TRUE", "sensitivity = 'non-sensitive'", "sensitivity_state", "sensitivity_state = 'false-positive'")),
    ("context-discrimination-rate", 0, False, f"CASE WHEN method = 'context-discrimination' THEN CASE WHEN count(*) FILTER ({_LENDS}) = 0 THEN 'numerator' ELSE {_lb('TRUE', _LENDS, 'sensitivity_state', 'sensitivity_state = ' + repr('correct'), True)} END END"),
    *[("benign-suppression-rate", 4, on, _lb("method = 'pii-benign'", "TRUE", "sensitivity_state", "sensitivity_state = 'correct'", not on)) for on in (False, True)],
    *[("jurisdiction-collision-rate", 4, on, _lb("method = 'jurisdiction-collision'", "TRUE", "type_state", "type_state IN ('correct', 'invalid-correct')", not on)) for on in (False, True)],
    ("measurable-share", 0, False, _lshare("type_state")),
    ("measurable-share", 0, False, _lshare("sensitivity_state", "sensitivity = 'not-established'")),
]
_LFOLD = ("lfold", "SELECT scanner_id, method, case_id, count(*) AS n, " + ", ".join(f"{body} AS b{i}" for i, (_, _, _, body) in enumerate(_LSTANDS)) + " FROM lrows GROUP BY scanner_id, method, case_id")
_LLONG = ("llong", "SELECT scanner_id, unnest([" + ", ".join(f"{{'metric': '{m}', 'bit': {bit}, 'lit': {on}, 'bucket': b{i}}}" for i, (m, bit, on, _) in enumerate(_LSTANDS)) + "], recursive := true) FROM lfold")
_LMIXED = ("lmixed", "SELECT scanner_id, bool_or(method = 'pii-benign' AND n > 1) AS mixed FROM lfold GROUP BY ALL")
_LCOUNTS = ("lcounts", f"""SELECT scanner_id, CAST(switches AS INT) AS switches, metric, {sql._COUNTS}, mixed AND switches & 2 > 0 AS refused FROM llong JOIN (SELECT unnest(range(8)) AS switches) ON bit = 0 OR (switches & bit > 0) = lit
JOIN lmixed USING (scanner_id) WHERE bucket IS NOT NULL GROUP BY ALL""")
_LEGACY_SQL = (*sql.ASSESSED, _LROWS, _LFOLD, _LLONG, _LMIXED, _LCOUNTS)
_LCOLS = ["scanner_id", "switches", "metric", *legacy.COUNTS, "refused"]


def _older(p: Of) -> DataFrame:
    return legacy.counts(p.outcomes().where("exp_start is not null"))


@query(sql.ask(f"SELECT {', '.join(_LCOLS)} FROM lcounts", _LEGACY_SQL))
def legacy_ten_metrics(spark: SparkSession, d: str) -> DataFrame:
    return _older(Of(spark, d)).select(*_LCOLS)


_SAME = " AND ".join(f"n.{c} = o.{c}" for c in legacy.COUNTS)


@query(sql.ask(f"""SELECT o.scanner_id, o.metric, arg_min(n.switches, bit_count(n.switches) * 8 + n.switches) AS switches
FROM (SELECT * REPLACE (CASE WHEN metric = 'sensitive-miss-rate' THEN numerator + 1 ELSE numerator END AS numerator) FROM lcounts WHERE switches = 5) o
LEFT JOIN lcounts n ON n.scanner_id = o.scanner_id AND n.metric = o.metric AND NOT n.refused AND {_SAME} GROUP BY ALL""", _LEGACY_SQL))
def explained_differences(spark: SparkSession, d: str) -> DataFrame:
    """Figures of the setting 5, one metric of which no setting explains."""
    found = staging.kept(_older(Of(spark, d)), "older")
    more = F.when(F.col("metric") == "sensitive-miss-rate", 1).otherwise(0)
    return legacy.explained(found, found.where("switches = 5").withColumn("numerator", F.col("numerator") + more))


_WORDS_OF = "CASE WHEN scanner_id IN (0, 3) AND variant_id % 3 = 0 THEN CASE WHEN variant_id % 2 = 0 THEN 'removed' ELSE 'residual-present' END END"


@query(sql.ask(f"SELECT {', '.join(KEYS)}, {_WORDS_OF} AS verdict FROM mat WHERE scanner_id < 2", (sql.MATRIX,)))
def replayed_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """What an original run said of each occurrence, for a replay of two of its scanners."""
    p = Of(spark, d)
    original = p.every().where("scanner_id in (0, 3) and variant_id % 3 = 0")
    said = original.select(*KEYS, F.when(F.col("variant_id") % 2 == 0, "removed").otherwise("residual-present").alias("verdict"))
    return p.every().where("scanner_id < 2").join(said, KEYS, "left").select(*KEYS, "verdict")


_KINDS = ["date-of-birth/global/labeled-field", "us-ssn/us/structured", "uk-nino/uk/structured", "email/global/basic", "iban/global", "iban/global/basic"]
_PLACES = ["global", "us", "uk", "fr"]


@query(f"""SELECT kind, place, count(*) AS n, CASE WHEN kind LIKE 'date-%' THEN CASE place WHEN 'uk' THEN 'pii:gb:date-of-birth' WHEN 'fr' THEN NULL ELSE 'pii:' || place || ':date-of-birth' END WHEN kind LIKE 'us-ssn%' THEN 'pii:us:ssn'
  WHEN kind LIKE 'uk-nino%' THEN 'pii:gb:national-insurance-number' WHEN kind = 'email/global/basic' THEN 'pii:global:email' WHEN kind = 'iban/global/basic' THEN 'pii:global:iban' END AS family,
  CASE WHEN kind = 'iban/global' THEN 'kind-unmapped' WHEN kind LIKE 'date-%' AND place = 'fr' THEN 'jurisdiction-unmapped' END AS code
FROM (SELECT {_KINDS!r}[1 + o_orderkey % {len(_KINDS)}] AS kind, {_PLACES!r}[1 + o_custkey % {len(_PLACES)}] AS place FROM orders) GROUP BY ALL""")
def evidence_families(spark: SparkSession, d: str) -> DataFrame:
    one = lambda names, key: F.element_at(F.array(*map(F.lit, names)), (F.col(key) % len(names) + 1).cast("int"))
    rows = _orders(spark, d).groupBy(one(_KINDS, "o_orderkey").alias("kind"), one(_PLACES, "o_custkey").alias("place")).agg(F.count("*").alias("n"))
    return rows.withColumn("x", records.kind_family(F.col("kind"), F.col("place"))).select("kind", "place", "n", "x.family", "x.code")
