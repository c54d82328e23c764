"""Queries over projections, capabilities, observations and derivations, each with its SQL. Importing this module registers them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import identity, ranges, records
from ..operators import accounting, attribution, compare, generate, projection, verify
from . import sql
from .queries import _SSN, _VIEW, AXES, KEYS, METRIC, Of, _ssn_state, _values, query

_CLASS = "CASE case_id % 6 WHEN 0 THEN 'decoy' WHEN 3 THEN 'lookalike' END"
VIEWS = ["benign", "core", "extended"]
_PLACED = ("placed", f"SELECT b.*, {_VIEW.replace('case_id', 'b.case_id')} AS view, {_CLASS.replace('case_id', 'b.case_id')} AS control_class, c.family FROM bucketed b JOIN cases c USING (case_id) WHERE bucket IS NOT NULL")
_CELL_COLS = ["scanner_id", "view", "family", *METRIC[1:], "stratum", "value"]


def _cells(stratum: str, value: str, where: str = "TRUE") -> str:
    return f"SELECT scanner_id, view, family, metric, {sql._COUNTS}, '{stratum}' AS stratum, {value} AS value FROM placed WHERE {where} GROUP BY ALL"


def _placed(p: Of) -> DataFrame:
    rows, of = p.cases_folded(("family",)), ("view", "family", "control_class")
    rows = rows.withColumn("view", F.expr(_VIEW)).withColumn("control_class", F.expr(_CLASS))
    return accounting.buckets(accounting.alike(rows, of), of)


_BY_CLASS = _cells("control_class", "control_class", "control_class IS NOT NULL")
_UPTO = (*sql.ASSESSED, sql.FOLDED, sql.BUCKETED, _PLACED)


@query(sql.ask(" UNION ALL ".join([_cells("overall", "CAST(NULL AS VARCHAR)"), _cells("language", "language"), _BY_CLASS]), _UPTO))
def projection_strata(spark: SparkSession, d: str) -> DataFrame:
    return projection.cells(_placed(Of(spark, d))).select(*_CELL_COLS)


@query(sql.ask(f"SELECT * EXCLUDE (stratum, value), value AS control_class FROM ({_BY_CLASS})", _UPTO))
def control_class_cells(spark: SparkSession, d: str) -> DataFrame:
    rows = projection.cells(_placed(Of(spark, d))).where("stratum = 'control_class'")
    return rows.select("scanner_id", "view", "family", *METRIC[1:], F.col("value").alias("control_class"))


_ROSTER = f"""SELECT case_id, CASE WHEN case_id % 53 = 0 THEN 'retired' ELSE {_VIEW} END AS view FROM cases WHERE case_id % 41 <> 0
UNION ALL SELECT case_id, 'core' FROM cases WHERE case_id % 43 = 0 UNION ALL SELECT -case_id, 'core' FROM cases WHERE case_id % 47 = 0"""
_CLASSES = f"""SELECT case_id, {_CLASS} AS control_class FROM cases WHERE case_id % 3 = 0
UNION ALL SELECT case_id, 'decoy' FROM cases WHERE case_id % 60 = 0 UNION ALL SELECT -case_id, 'decoy' FROM cases WHERE case_id % 66 = 0"""
_FAMILY = ("one_family", "SELECT case_id, CASE WHEN count(DISTINCT f) = 1 THEN min(f) END AS family FROM (SELECT case_id, CASE WHEN case_id % 59 = 0 AND occurrence_id = 1 THEN 'iban' ELSE family END AS f FROM expectations) GROUP BY case_id")


@query(sql.ask("""SELECT CAST(case_id AS VARCHAR) AS subject, 'unknown-case' AS code FROM roster WHERE case_id NOT IN (SELECT case_id FROM cases)
UNION ALL SELECT CAST(case_id AS VARCHAR), 'view-not-required' FROM roster WHERE view NOT IN ('benign', 'core', 'extended', 'stress')
UNION ALL SELECT CAST(case_id AS VARCHAR), 'duplicate-assignment' FROM roster GROUP BY case_id HAVING count(*) > 1
UNION ALL SELECT CAST(case_id AS VARCHAR), 'unassigned-case' FROM cases WHERE case_id NOT IN (SELECT case_id FROM roster)
UNION ALL SELECT v, 'empty-required-view' FROM (VALUES ('benign'), ('core'), ('extended'), ('stress')) t(v) WHERE v NOT IN (SELECT view FROM roster)
UNION ALL SELECT CAST(case_id AS VARCHAR), 'ambiguous-family' FROM one_family WHERE family IS NULL
UNION ALL SELECT CAST(case_id AS VARCHAR), 'unknown-control-case' FROM classes WHERE case_id NOT IN (SELECT case_id FROM cases)
UNION ALL SELECT CAST(case_id AS VARCHAR), 'duplicate-control-assignment' FROM classes GROUP BY case_id HAVING count(*) > 1""", (("roster", _ROSTER), ("classes", _CLASSES), _FAMILY)))
def roster_defects(spark: SparkSession, d: str) -> DataFrame:
    """A roster with cases that are unknown, unassigned or assigned twice, a view too many and one without a case."""
    p = Of(spark, d)
    ids = p.cases.select("case_id")
    some = lambda n: ids.where(f"case_id % {n} = 0")
    view = F.when(F.col("case_id") % 53 == 0, "retired").otherwise(F.expr(_VIEW))
    roster = ids.where("case_id % 41 <> 0").select("case_id", view.alias("view"))
    roster = roster.union(some(43).select("case_id", F.lit("core"))).union(some(47).select(-F.col("case_id"), F.lit("core")))
    classes = some(3).select("case_id", F.expr(_CLASS).alias("control_class"))
    classes = classes.union(some(60).select("case_id", F.lit("decoy"))).union(some(66).select(-F.col("case_id"), F.lit("decoy")))
    family = F.when((F.col("case_id") % 59 == 0) & (F.col("occurrence_id") == 1), "iban").otherwise(F.col("family"))
    families = projection.case_families(p.expectations.select("case_id", family.alias("family"), F.lit(None).cast("string").alias("target")))
    return projection.roster_defects(families, roster, classes, [*VIEWS, "stress"])


_WANTED = ("wanted", f"SELECT scanner_id, {_VIEW} AS view, family, count(DISTINCT case_id) AS cases, count(DISTINCT variant_id) AS variants, count(*) AS occurrences FROM mat GROUP BY ALL")
_STORED = ("stored", "SELECT scanner_id, view, CASE WHEN scanner_id = 1 AND view = 'core' AND family = 'card' THEN 'email' ELSE family END AS family, CAST(sum(cases - CASE WHEN scanner_id = 2 AND family = 'ssn' THEN 1 ELSE 0 END) AS BIGINT) AS cases, CAST(sum(variants) AS BIGINT) AS variants, CAST(sum(occurrences) AS BIGINT) AS occurrences FROM wanted WHERE scanner_id <> 3 OR view <> 'benign' GROUP BY ALL")


def _products(p: Of) -> tuple[DataFrame, DataFrame]:
    """Recomputed cells, and stored ones: a cell merged into another, cases left out, a view left out."""
    wanted = projection.authored(p.expectations.withColumn("view", F.expr(_VIEW)), p.scanners)
    stored = wanted.where("scanner_id <> 3 or view <> 'benign'").withColumn("cases", F.col("cases") - F.when((F.col("scanner_id") == 2) & (F.col("family") == "ssn"), 1).otherwise(0))
    stored = stored.withColumn("family", F.when(F.expr("scanner_id = 1 and view = 'core' and family = 'card'"), "email").otherwise(F.col("family")))
    return wanted, stored.groupBy(*projection.CELL).agg(*[F.sum(c).alias(c) for c in projection.COUNTED])


@query(sql.ask("""SELECT scanner_id, view, family, CASE WHEN s.cases > w.cases OR s.variants > w.variants OR s.occurrences > w.occurrences THEN 'projection-pooled-denominator' ELSE 'count-mismatch' END AS code
FROM wanted w FULL JOIN stored s USING (scanner_id, view, family) WHERE s.cases IS DISTINCT FROM w.cases OR s.variants IS DISTINCT FROM w.variants OR s.occurrences IS DISTINCT FROM w.occurrences""", (sql.MATRIX, _WANTED, _STORED)))
def projection_diff(spark: SparkSession, d: str) -> DataFrame:
    wanted, stored = _products(Of(spark, d))
    return projection.compare_cells(stored, wanted)


@query(sql.ask("""SELECT s.scanner_id, v.view, 'projection-view-missing' AS code FROM scanners s, (VALUES ('benign'), ('core'), ('extended')) v(view) WHERE NOT EXISTS (SELECT 1 FROM stored t WHERE t.scanner_id = s.scanner_id AND t.view = v.view)
UNION ALL SELECT scanner_id, NULL, CASE WHEN c > cases OR v > variants OR o > occurrences THEN 'projection-pooled-denominator' ELSE 'count-mismatch' END
FROM (SELECT scanner_id, sum(cases) AS c, sum(variants) AS v, sum(occurrences) AS o FROM stored GROUP BY ALL),
  (SELECT count(DISTINCT case_id) AS cases, count(DISTINCT variant_id) AS variants, count(*) AS occurrences FROM expectations) WHERE c <> cases OR v <> variants OR o <> occurrences""", (sql.MATRIX, _WANTED, _STORED)))
def projection_sum_defects(spark: SparkSession, d: str) -> DataFrame:
    p = Of(spark, d)
    totals = p.expectations.agg(F.countDistinct("case_id").alias("cases"), F.countDistinct("variant_id").alias("variants"), F.count("*").alias("occurrences"))
    return projection.sum_defects(_products(p)[1], totals, p.scanners, VIEWS)


@query(sql.ask(f"SELECT variant_id, occurrence_id FROM expectations WHERE {_VIEW} = 'extended'", ()))
def restricted_view(spark: SparkSession, d: str) -> DataFrame:
    p = Of(spark, d)
    return projection.restricted(p.expectations, p.cases.select("case_id", F.expr(_VIEW).alias("view")), "extended").select("variant_id", "occurrence_id")


@query(sql.ask(f"SELECT {_VIEW} AS view, count(*) FILTER (sensitivity = 'non-sensitive') > count(*) FILTER (sensitivity = 'sensitive') AS benign_dominant FROM expectations GROUP BY ALL", ()))
def view_dominance(spark: SparkSession, d: str) -> DataFrame:
    count = lambda s: F.count_if(F.col("sensitivity") == s)
    return Of(spark, d).expectations.groupBy(F.expr(_VIEW).alias("view")).agg((count("non-sensitive") > count("sensitive")).alias("benign_dominant"))


_TOLD = "CASE WHEN scanner_id IN (0, 3) AND status = 'complete' AND NOT text_negative AND variant_id % 3 = 0 THEN CASE WHEN variant_id % 2 = 0 THEN 'removed' ELSE 'residual-present' END END"


@query(sql.ask(f"SELECT {', '.join(KEYS)}, CASE WHEN verdict IS NOT NULL THEN 'output-verified' ELSE action_state END AS action_state, CASE WHEN verdict IS NULL THEN action END AS action, verdict FROM (SELECT *, {_TOLD} AS verdict FROM outcomes)", sql.ASSESSED))
def verified_actions(spark: SparkSession, d: str) -> DataFrame:
    """Scanners 0 and 3 declare sanitized outputs; verdicts exist for scanners 0, 1 and 3."""
    p = Of(spark, d)
    rows = p.outcomes()
    told = p.every().where("scanner_id in (0, 1, 3) and variant_id % 3 = 0")
    verdict = F.when(F.col("variant_id") % 2 == 0, "removed").otherwise("residual-present")
    return projection.with_verdicts(rows, told.withColumn("verdict", verdict)).select(*KEYS, "action_state", "action", "verdict")


@query(sql.ask(f"""SELECT {', '.join(AXES)} FROM outcomes WHERE CASE scanner_id WHEN 0 THEN range_state <> 'not-applicable' WHEN 1 THEN type_state <> 'not-measured'
  WHEN 2 THEN type_state = 'wrong-jurisdiction' OR action_state IN ('reported', 'no-action-reported') ELSE sensitivity_state <> 'not-measured' END""", sql.ASSESSED))
def capability_contradictions(spark: SparkSession, d: str) -> DataFrame:
    """Outcomes against other declarations than those they come from: each scanner lacks one or two capabilities here."""
    rows, has = Of(spark, d).outcomes(), lambda s, c: F.when(F.col("scanner_id") == s, "unsupported").otherwise("supported").alias(c)
    caps = [has(0, "cap_ranges"), has(1, "cap_family"), has(2, "cap_jurisdiction"), has(3, "cap_sensitivity"), F.when(F.col("scanner_id") == 2, "unavailable").otherwise("reported").alias("cap_action")]
    return rows.select(*AXES, *caps).where(verify.capability_conflict()).select(*AXES)


_KEY = "(f_start, f_end, coalesce(f_family, ''), coalesce(f_jurisdiction, ''), coalesce(f_sensitive::INT, -1), coalesce(f_action, ''))"
_LAG = "lag({0}) OVER (PARTITION BY scanner_id, variant_id ORDER BY emission, {0})"


@query(sql.ask(f"""SELECT * FROM (VALUES (1, CAST(NULL AS BIGINT), 'status-inconsistent'), (2, NULL, 'status-inconsistent'), (3, NULL, 'status-inconsistent')) t(scanner_id, variant_id, code)
UNION ALL SELECT DISTINCT scanner_id, variant_id, 'non-canonical-order' FROM (SELECT *, {_KEY} AS k, {_LAG.format(_KEY)} AS l FROM findings) WHERE l > k
UNION ALL SELECT DISTINCT scanner_id, variant_id, 'range-invalid' FROM findings WHERE f_start >= f_end
UNION ALL SELECT DISTINCT scanner_id, variant_id, 'capability-contradiction' FROM findings WHERE scanner_id = 2 AND f_jurisdiction IS NOT NULL""", ()))
def observation_defects(spark: SparkSession, d: str) -> DataFrame:
    """Scanner 1 has no replay, 2 is complete though its replays disagree and names jurisdictions it can't, 3 has inputs though unstable."""
    p = Of(spark, d)
    n = F.col("scanner_id")
    scanners = p.scanners.withColumn("replays", F.when(n == 1, 0).otherwise(2)).withColumn("agreed", n < 2)
    scanners = scanners.withColumn("cap_ranges", F.lit("supported")).withColumn("cap_jurisdiction", F.when(n == 2, "unsupported").otherwise("supported"))
    return verify.observation_defects(scanners, p.findings)


_SCOPED = """SELECT variant_id, occurrence_id, text_negative, jurisdiction, sensitivity, CASE WHEN case_id % 37 = 0 THEN 'valid' ELSE type_expectation END AS type_expectation, exp_start,
  CASE WHEN case_id % 41 = 0 THEN exp_start ELSE exp_end END AS exp_end, 'pii:' || CASE WHEN case_id % 43 = 0 THEN 'fr' ELSE coalesce(lower(jurisdiction), 'global') END || ':' || family AS family FROM expectations"""


@query(sql.ask("""SELECT variant_id, occurrence_id, 'range-not-established-invalid' AS code FROM e WHERE exp_start IS NULL AND (type_expectation = 'valid' OR (NOT text_negative AND (type_expectation <> 'not-established' OR sensitivity <> 'not-established'))
  OR (text_negative AND (sensitivity = 'sensitive' OR (type_expectation <> 'invalid' AND sensitivity <> 'non-sensitive'))))
UNION ALL SELECT variant_id, occurrence_id, 'range-invalid' FROM e WHERE exp_start >= exp_end
UNION ALL SELECT variant_id, occurrence_id, 'family-scope-mismatch' FROM e WHERE upper(split_part(family, ':', 2)) <> coalesce(jurisdiction, 'GLOBAL')""", (("e", _SCOPED),)))
def expectation_defects(spark: SparkSession, d: str) -> DataFrame:
    rows, case = Of(spark, d).expectations, F.col("case_id")
    scope = F.when(case % 43 == 0, "fr").otherwise(F.coalesce(F.lower("jurisdiction"), F.lit("global")))
    rows = rows.withColumn("family", F.concat(F.lit("pii:"), scope, F.lit(":"), F.col("family"))).withColumn("exp_end", F.when(case % 41 == 0, F.col("exp_start")).otherwise(F.col("exp_end")))
    rows = rows.withColumn("type_expectation", F.when(case % 37 == 0, "valid").otherwise(F.col("type_expectation")))
    return verify.expectation_defects(rows).select("variant_id", "occurrence_id", "code")


@query(sql.ask("""SELECT scanner_id, metric FROM (SELECT * REPLACE (CASE scanner_id WHEN 0 THEN total + 1 ELSE total END AS total, CASE scanner_id WHEN 1 THEN measured + 1 ELSE numerator END AS numerator) FROM tallied WHERE stratum = 'overall')
WHERE eligible + not_applicable <> total OR measured + unresolved + not_measured <> eligible OR numerator > measured"""))
def inconsistent_counts(spark: SparkSession, d: str) -> DataFrame:
    """Overall counts with a total too large for scanner 0 and a numerator too large for scanner 1."""
    n = F.col("scanner_id")
    rows = accounting.tallies(Of(spark, d).bucketed()).where("stratum = 'overall'")
    rows = rows.withColumn("total", F.col("total") + F.when(n == 0, 1).otherwise(0)).withColumn("numerator", F.when(n == 1, F.col("measured") + 1).otherwise(F.col("numerator")))
    return rows.where(~verify.counts_consistent()).select("scanner_id", "metric")


_STATUS = "CASE c_custkey % 5 WHEN 0 THEN 'complete' WHEN 1 THEN 'unsupported' WHEN 2 THEN 'unavailable' WHEN 3 THEN 'unstable' ELSE 'error' END"
_FAILED = "CASE c_custkey % 4 WHEN 0 THEN 'timeout' WHEN 1 THEN 'replay-disagreement' WHEN 2 THEN 'unsupported' ELSE 'unavailable' END"


@query(f"SELECT c_custkey, (status, failure) IN (('unsupported', 'unsupported'), ('unavailable', 'unavailable'), ('unstable', 'replay-disagreement'), ('error', 'timeout')) AS allowed FROM (SELECT c_custkey, {_STATUS} AS status, {_FAILED} AS failure FROM customer)")
def failure_codes(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/customer.parquet").select("c_custkey", verify.failure_allowed(F.expr(_STATUS), F.expr(_FAILED)).alias("allowed"))


@query(sql.ask("""SELECT scanner_id, variant_id, code FROM (SELECT *, row_number() OVER (PARTITION BY scanner_id ORDER BY variant_id, code) AS r
FROM (SELECT scanner_id, variant_id, CASE WHEN emission % 2 = 0 THEN 'timeout' ELSE 'malformed-output' END AS code FROM findings WHERE case_id % 31 = 0)) WHERE r = 1""", ()))
def first_failures(spark: SparkSession, d: str) -> DataFrame:
    code = F.when(F.col("emission") % 2 == 0, "timeout").otherwise("malformed-output")
    return verify.first_failures(Of(spark, d).findings.where("case_id % 31 = 0").select("scanner_id", "variant_id", code.alias("code")))


_FIELD = "unhex(printf('%08x', strlen({0}))) || encode({0})"
_SEED = " || ".join(_FIELD.format(f) for f in ("'seeds'", "'generator'", "'2'", "'s-' || o_custkey", "'case-' || o_orderkey", "'authored'"))


@query(f"SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN 's-' || o_custkey ELSE sha256({_SEED}) END AS seed FROM orders")
def variant_seeds(spark: SparkSession, d: str) -> DataFrame:
    rule = F.when(F.col("o_orderkey") % 4 == 0, "legacy-case-seed").otherwise("pii-seed-v1")
    own, case = F.concat(F.lit("s-"), F.col("o_custkey")), F.concat(F.lit("case-"), F.col("o_orderkey"))
    seed = identity.variant_seed(rule, "seeds", F.lit("generator"), F.lit(2), own, case, F.lit("authored"))
    return spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", seed.alias("seed"))


_DRAW = "('0x' || substr(sha256('s-' || o_orderkey || '/{0}'), 1, 8))::BIGINT"


@query("SELECT o_orderkey, 'X-' || " + " || '-' || ".join([f"chr(65 + ({_DRAW.format(0)} % 26)::INT) || ({_DRAW.format(1)} % 10)", f"({_DRAW.format(2)} % 10) || chr(65 + ({_DRAW.format(3)} % 26)::INT)"]) + " AS candidate FROM orders")
def patterned_candidates(spark: SparkSession, d: str) -> DataFrame:
    seed = F.concat(F.lit("s-"), F.col("o_orderkey"))
    return spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", identity.patterned(seed, F.lit("X-AD-DA")).alias("candidate"))


@query("""SELECT o_orderkey, CASE WHEN m > 9007199254740991 THEN NULL WHEN m = 0 THEN 0 ELSE m // CAST(pow(10, z) AS BIGINT) END AS mantissa, CASE WHEN m > 9007199254740991 THEN NULL WHEN m = 0 THEN 0 ELSE s - z END AS scale
FROM (SELECT *, least(s, length(CAST(m AS VARCHAR)) - length(rtrim(CAST(m AS VARCHAR), '0'))) AS z FROM (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 0 WHEN 1 THEN o_custkey * 1000 WHEN 2 THEN o_custkey ELSE 9007199254740992 END AS m, CAST(o_orderkey % 6 AS INT) AS s FROM orders))""")
def scaled_decimals(spark: SparkSession, d: str) -> DataFrame:
    kind, c = F.col("o_orderkey") % 4, F.col("o_custkey").cast("long")
    mantissa = F.when(kind == 0, F.lit(0).cast("long")).when(kind == 1, c * 1000).when(kind == 2, c).otherwise(F.lit(9007199254740992))
    found = identity.scaled_decimal(mantissa, (F.col("o_orderkey") % 6).cast("int"))
    return spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", found.alias("x")).select("o_orderkey", "x.mantissa", "x.scale")


_AUTHORED = f"""SELECT *, CASE WHEN validator IS NULL THEN NULL WHEN validator = 'unknown' THEN 'unavailable' ELSE {_ssn_state("digits")} END AS observed
FROM (SELECT o_orderkey AS case_id, replace({_SSN}, '-', '') AS digits, CASE o_orderkey % 2 WHEN 0 THEN 'type-validation' ELSE 'reference-differential' END AS method,
  CASE o_orderkey % 3 WHEN 0 THEN 'valid' WHEN 1 THEN 'invalid' ELSE 'not-established' END AS type_expectation, CASE o_orderkey % 5 WHEN 0 THEN NULL WHEN 1 THEN 'unknown' ELSE 'us-ssn-allocation' END AS validator FROM orders)"""


@query(f"""SELECT case_id, method, observed, reason, CASE WHEN observed = 'unavailable' THEN short || '-unavailable' WHEN differs AND short = 'reference' THEN 'reference-disagrees' END AS review,
  CASE WHEN reason IS NULL THEN CASE WHEN observed = 'unavailable' THEN 'review-required' ELSE 'authored' END END AS strategy
FROM (SELECT *, CASE WHEN observed IS NULL THEN 'missing-' || short WHEN differs AND short = 'validator' THEN 'validator-expectation-mismatch' END AS reason
FROM (SELECT *, CASE WHEN method = 'type-validation' THEN 'validator' ELSE 'reference' END AS short, observed <> 'unavailable' AND type_expectation <> 'not-established' AND observed <> type_expectation AS differs FROM ({_AUTHORED})))""")
def validator_agreement(spark: SparkSession, d: str) -> DataFrame:
    rows, k = _values(spark, d), F.col("case_id")
    validator = F.when(k % 5 == 1, "unknown").when(k % 5 != 0, "us-ssn-allocation")
    kind = F.when(k % 3 == 0, "valid").when(k % 3 == 1, "invalid").otherwise("not-established")
    rows = rows.select("case_id", F.regexp_replace("ssn", "-", "").alias("value"), kind.alias("type_expectation"), validator.alias("validator"), F.lit(1).alias("version"))
    rows = rows.withColumn("method", F.when(k % 2 == 0, "type-validation").otherwise("reference-differential"))
    return generate.held_against_validator(rows).select("case_id", "method", "observed", "reason", "review", "strategy")


@query("""SELECT p_brand, round(max(ln(y / ly) / ln(x / lx)), 6) AS slope FROM (SELECT *, lag(x) OVER w AS lx, lag(y) OVER w AS ly
FROM (SELECT p_brand, CAST(p_size AS DOUBLE) AS x, max(CAST(p_retailprice AS DOUBLE)) AS y FROM part WHERE p_size > 0 AND p_retailprice > 0 GROUP BY ALL) WINDOW w AS (PARTITION BY p_brand ORDER BY x)) GROUP BY p_brand""")
def neighbour_slopes(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.read.parquet(f"{d}/part.parquet").where("p_size > 0 and p_retailprice > 0")
    rows = rows.groupBy("p_brand", F.col("p_size").cast("double").alias("x")).agg(F.max(F.col("p_retailprice").cast("double")).alias("y"))
    return compare.steepest(rows, "p_brand", "x", "y").select("p_brand", F.round("slope", 6).alias("slope"))


@query("""SELECT 'orders' AS owner, CAST(o_orderkey AS VARCHAR) AS id, 'customer' AS field, CAST(o_custkey AS VARCHAR) AS target FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 9 <> 0)
UNION ALL SELECT 'suppliers', CAST(s_suppkey AS VARCHAR), 'nation', CAST(s_nationkey AS VARCHAR) FROM supplier WHERE s_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_nationkey % 5 <> 0)
UNION ALL SELECT 'customers', CAST(c_custkey AS VARCHAR), 'nations', CAST(n AS VARCHAR) FROM (SELECT c_custkey, unnest([c_nationkey, c_nationkey + 1]) AS n FROM customer WHERE c_custkey % 9 <> 0) WHERE n NOT IN (SELECT n_nationkey FROM nation WHERE n_nationkey % 5 <> 0)""")
def unresolved_references(spark: SparkSession, d: str) -> DataFrame:
    """References by one id and by an array of ids, to tables that lack some rows."""
    read = lambda t: spark.read.parquet(f"{d}/{t}.parquet")
    tables = {
        "orders": read("orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("customer")),
        "customers": read("customer").where("c_custkey % 9 <> 0").select(F.col("c_custkey").alias("id"), F.array("c_nationkey", F.col("c_nationkey") + 1).alias("nations")),
        "suppliers": read("supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("nation")),
        "nations": read("nation").where("n_nationkey % 5 <> 0").select(F.col("n_nationkey").alias("id")),
    }
    return verify.unresolved(tables, [("orders", "customer", "customers"), ("suppliers", "nation", "nations"), ("customers", "nations", "nations")])


_FIRST = ("firsts", """SELECT scanner_id, variant_id, occurrence_id, f_start, f_end, f_family, f_jurisdiction, f_sensitive FROM pairs
QUALIFY row_number() OVER (PARTITION BY scanner_id, variant_id, occurrence_id ORDER BY emission, f_start, f_end, f_family NULLS FIRST, f_jurisdiction NULLS FIRST, f_sensitive NULLS FIRST) = 1""")
_READ = ("readings", """SELECT o.scanner_id, o.case_id, o.variant_id, o.occurrence_id, s.bits, o.type_state, o.sensitivity_state, o.range_state, o.family, o.jurisdiction, o.sensitivity, o.cap_sensitivity, o.exp_start, o.exp_end,
  o.cap_family = 'unsupported' OR o.family_state = 'unsupported' OR coalesce(o.place_state = 'unsupported', FALSE) AS ruled_out, b.f_start IS NOT NULL AS seen,
  CASE WHEN s.bits & 1 = 1 THEN a.f_start ELSE b.f_start END AS fs, CASE WHEN s.bits & 1 = 1 THEN a.f_end ELSE b.f_end END AS fe, CASE WHEN s.bits & 1 = 1 THEN a.f_family ELSE b.f_family END AS ff,
  CASE WHEN s.bits & 1 = 1 THEN a.f_jurisdiction ELSE b.f_jurisdiction END AS fj, CASE WHEN s.bits & 1 = 1 THEN a.f_sensitive ELSE b.f_sensitive END AS fl
FROM outcomes o CROSS JOIN (SELECT CAST(range AS INT) AS bits FROM range(16)) s LEFT JOIN (SELECT * FROM ranked WHERE rn = 1) a USING (scanner_id, variant_id, occurrence_id) LEFT JOIN firsts b USING (scanner_id, variant_id, occurrence_id)
WHERE o.status = 'complete' AND o.exp_start IS NOT NULL AND o.type_expectation = 'valid' AND o.sensitivity IN ('sensitive', 'non-sensitive')""")
_READ_AS = ("read_as", """SELECT *, CASE WHEN bits & 4 = 4 AND ruled_out THEN 'not-measured' WHEN NOT seen THEN 'miss' WHEN ff IS NULL THEN CASE WHEN bits & 2 = 2 THEN 'not-measured' ELSE 'wrong-family' END
    WHEN ff <> family THEN CASE WHEN bits & 8 = 8 AND fj <> jurisdiction THEN 'wrong-jurisdiction' ELSE 'wrong-family' END
    WHEN jurisdiction IS NOT NULL AND fj IS NULL THEN CASE WHEN bits & 2 = 2 THEN 'not-measured' ELSE 'wrong-jurisdiction' END WHEN fj <> jurisdiction THEN 'wrong-jurisdiction' ELSE 'correct' END AS t,
  CASE WHEN bits & 4 = 4 AND cap_sensitivity = 'unsupported' THEN 'not-measured' WHEN seen AND fl IS NULL AND bits & 2 = 2 OR NOT seen AND bits & 4 = 4 AND cap_sensitivity <> 'supported' THEN 'not-measured'
    WHEN (sensitivity = 'sensitive') = (seen AND coalesce(fl, FALSE)) THEN 'correct' WHEN seen AND coalesce(fl, FALSE) THEN 'false-positive' ELSE 'miss' END AS m,
  CASE WHEN NOT seen THEN 'miss' WHEN fs = exp_start AND fe = exp_end THEN 'exact' WHEN fs <= exp_start AND fe >= exp_end THEN 'overbroad' ELSE 'partial' END AS r FROM readings""")


@query(sql.ask("""SELECT scanner_id, switches, count(*) AS n, least.a AS case_id, least.b AS variant_id, least.c AS occurrence_id FROM (SELECT scanner_id, switches, min({'a': case_id, 'b': variant_id, 'c': occurrence_id}) OVER (PARTITION BY scanner_id, switches) AS least
  FROM (SELECT scanner_id, case_id, variant_id, occurrence_id, arg_min(bits, bit_count(bits) * 16 + bits) FILTER (t = type_state AND m = sensitivity_state AND r = range_state) AS switches FROM read_as GROUP BY ALL)) GROUP BY ALL""", (*sql.ASSESSED, _FIRST, _READ, _READ_AS)))
def difference_census(spark: SparkSession, d: str) -> DataFrame:
    """What leads from the older reading of a finding to the present one: the order first, then the fewest other switches, with the least row of each."""
    p = Of(spark, d)
    return attribution.census(attribution.attributed(p.outcomes(), p.findings))


_STALE = {
    "numerator": "CASE WHEN metric = 'type-miss-rate' AND numerator < measured THEN numerator + 1 ELSE numerator END",
    "status": "CASE WHEN metric = 'wrong-family-rate' AND scanner_id = 0 THEN 'unknown' ELSE status END",
    "n": "CASE WHEN metric = 'measurable-share' AND scanner_id < 2 THEN n + 1 ELSE n END",
    "point": "CASE WHEN metric = 'range-collateral-rate' THEN point + 1 ELSE point END",
    "measured": "CASE WHEN metric = 'benign-suppression-rate' AND measured > 0 THEN measured - 1 ELSE measured END",
}
_STORED = ("stored", "SELECT * REPLACE (" + ", ".join(f"{e} AS {c}" for c, e in _STALE.items()) + ") FROM published")
_AGAIN = ("again", sql.PUBLISHED[1].replace("FROM tallied", "FROM (SELECT * EXCLUDE (n, status, value_state, point, bound), struct_pack(n, status, value_state, point, bound) AS given FROM stored)"))
_CHECKED = """SELECT scanner_id, metric, stratum, value, path, CASE path WHEN 'value' THEN 'metric-value-inconsistent' ELSE 'metric-counts-inconsistent' END AS code FROM (SELECT *, CASE
  WHEN eligible + not_applicable <> total OR measured + unresolved + not_measured <> eligible OR numerator > measured OR status <> given.status THEN 'counts' WHEN n <> given.n THEN 'effectiveN'
  WHEN value_state <> given.value_state OR point IS DISTINCT FROM given.point OR bound IS DISTINCT FROM given.bound THEN 'value' END AS path FROM again) WHERE path IS NOT NULL"""


@query(sql.ask(_CHECKED, (*sql.ALL, _STORED, _AGAIN)))
def metric_self_check(spark: SparkSession, d: str) -> DataFrame:
    """Published results that contradict themselves, after changes to five of their columns."""
    return verify.metric_defects(Of(spark, d).metrics().withColumns({c: F.expr(e) for c, e in _STALE.items()}))


_NUMBERS = "eligible, measured, numerator, unresolved, not_measured, not_applicable, total"
_BACK = """SELECT coalesce(a.scanner_id, b.scanner_id) AS scanner_id, coalesce(a.metric, b.metric) AS metric, coalesce(a.stratum, b.stratum) AS stratum, coalesce(a.value, b.value) AS value,
  CASE WHEN a.metric IS NULL THEN 'result-missing' WHEN b.metric IS NULL THEN 'unknown-result' WHEN (a.eligible, a.measured, a.numerator, a.unresolved, a.not_measured, a.not_applicable, a.total) <> (b.eligible, b.measured, b.numerator, b.unresolved, b.not_measured, b.not_applicable, b.total) THEN 'count-mismatch'
  WHEN (a.n, a.status, a.value_state, a.point, a.bound) IS DISTINCT FROM (b.n, b.status, b.value_state, b.point, b.bound) THEN 'metric-value-inconsistent' END AS code
FROM (SELECT * REPLACE (CASE WHEN value = 'ko' THEN 'xx' ELSE value END AS value) FROM stored) a FULL JOIN published b ON a.scanner_id = b.scanner_id AND a.metric = b.metric AND a.stratum = b.stratum AND a.value IS NOT DISTINCT FROM b.value"""


@query(sql.ask(f"SELECT * FROM ({_BACK}) WHERE code IS NOT NULL", (*sql.ALL, _STORED)))
def metric_result_diff(spark: SparkSession, d: str) -> DataFrame:
    """Stored results, changed and with one stratum renamed, against those recomputed from rows."""
    now = Of(spark, d).kept_metrics()
    stored = now.withColumns({c: F.expr(e) for c, e in _STALE.items()}).withColumn("value", F.when(F.col("value") == "ko", "xx").otherwise(F.col("value")))
    return verify.result_diff(stored, now)


_DECLARED = """'{"capFamily":"' || cap_family || '","capSensitivity":"' || cap_sensitivity || '","status":"' || status || '","version":"' || version || '"}'"""


@query(sql.ask(f"SELECT scanner_id, sha256('canonical' || chr(10) || 'scanner' || chr(10) || {_DECLARED}) AS digest, l.digest IS NOT NULL AND l.digest <> sha256({_DECLARED}) AS changed FROM earlier e LEFT JOIN (SELECT scanner_id, sha256({_DECLARED}) AS digest FROM later) l USING (scanner_id)", ()))
def scanner_digests(spark: SparkSession, d: str) -> DataFrame:
    """Digests of what each scanner of a run declares, and whether the later run declares something else."""
    p, names = Of(spark, d), {"cap_family": "capFamily", "cap_sensitivity": "capSensitivity"}

    def told(rows: DataFrame, name: str) -> DataFrame:
        packed = rows.select("scanner_id", F.struct(*[F.col(c).alias(names.get(c, c)) for c in ("status", "cap_family", "cap_sensitivity", "version")]).alias("r"))
        return packed.select("scanner_id", records.semantic_digest("canonical", "scanner", records.canonical(F.col("r"), packed.schema["r"].dataType)).alias(name))

    rows = told(p.earlier, "digest").join(told(p.later, "then"), "scanner_id", "left")
    return rows.select("scanner_id", "digest", (F.col("then").isNotNull() & (F.col("then") != F.col("digest"))).alias("changed"))


_HEX = "hex(encode(text))"
_TORN = f"('0x' || coalesce(nullif(substr({_HEX}, CAST(2 * k + 1 AS BIGINT), 2), ''), '00'))::INT & 192 = 128"


@query(f"""SELECT doc_id, CASE WHEN torn THEN 'not-utf8' WHEN s > e THEN 'inverted' WHEN s = e THEN 'empty' WHEN e > k THEN 'out-of-bounds' WHEN s_in OR e_in THEN 'not-a-boundary' END AS defect FROM (SELECT *, {_TORN} AS torn,
  s < k AND {_TORN.replace('k + 1', 's + 1')} AS s_in, e < k AND {_TORN.replace('k + 1', 'e + 1')} AS e_in FROM (SELECT doc_id, text, least(strlen(text), doc_id % 90 + 3) AS k, doc_id % 50 AS s, doc_id % 37 + 10 AS e FROM documents)) WHERE defect IS NOT NULL""")
def raw_range_defects(spark: SparkSession, d: str) -> DataFrame:
    """Ranges in the first bytes of each text; some texts are cut inside a character."""
    raw = F.encode("text", "UTF-8")
    size = F.least(F.octet_length(raw).cast("long"), F.col("doc_id") % 90 + 3)
    rows = spark.read.parquet(f"{d}/documents.parquet").where("text is not null").select("doc_id", F.substring(raw, F.lit(1), size.cast("int")).alias("raw"))
    defect = ranges.range_error_bytes(F.col("raw"), F.col("doc_id") % 50, F.col("doc_id") % 37 + 10)
    return rows.select("doc_id", defect.alias("defect")).where("defect is not null")
