"""The registered queries over the derived population and the text tables, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import exchange, identity, ranges, stats
from ..operators import accounting, compare, evidence, generate, matching, outputs, verify
from ..sources import population, staging
from . import sql

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(oracle: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if oracle:
            SQL[f.__name__] = oracle
        return f

    return add


#: What the population's tables are dealt by: line items meet their variants by the case.
WITHIN = "case_id"


class Of:
    """The population's tables for one folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return population.read(self.spark, self.dir, name) if name in population.TABLES else self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def every(self) -> DataFrame:
        return matching.matrix(self.expectations, self.scanners)

    def outcomes(self, observed: bool = False) -> DataFrame:
        return matching.assess(self.expectations, self.scanners, self.findings, observed, WITHIN)

    def cases_folded(self, keep: tuple[str, ...] = ()) -> DataFrame:
        return accounting.case_standings(self.outcomes(), keep)

    def bucketed(self) -> DataFrame:
        return accounting.buckets(accounting.alike(self.cases_folded()))

    def kept_metrics(self) -> DataFrame:
        """The metrics, worked out once, for those that read them twice."""
        return staging.kept(self.metrics(), "metrics")

    def metrics(self) -> DataFrame:
        return accounting.published(accounting.tallies(self.bucketed()))


STATES = ["type_state", "sensitivity_state", "range_state", "action_state"]
KEYS = ["scanner_id", "case_id", "variant_id", "occurrence_id"]
AXES = KEYS + STATES
METRIC = ["scanner_id", "metric", "eligible", "measured", "numerator", "unresolved", "not_measured", "not_applicable", "total"]
_AXES, _METRIC = ", ".join(AXES), ", ".join(METRIC)


@query(sql.ask("SELECT scanner_id, variant_id, occurrence_id, f_start, f_end, relation, count(*) AS n FROM pairs GROUP BY ALL", (sql.MATRIX, sql.PAIRS)))
def overlap_candidates(spark: SparkSession, d: str) -> DataFrame:
    p = Of(spark, d)
    rows = matching.candidates(p.expectations, p.findings)
    kind = ranges.relation(*(F.col(c) for c in ("exp_start", "exp_end", "f_start", "f_end")))
    return rows.groupBy("scanner_id", "variant_id", "occurrence_id", "f_start", "f_end", kind.alias("relation")).agg(F.count("*").alias("n"))


@query(sql.ask("SELECT relation, count(*) AS n FROM pairs GROUP BY ALL", (sql.MATRIX, sql.PAIRS)))
def relation_histogram(spark: SparkSession, d: str) -> DataFrame:
    return overlap_candidates(spark, d).groupBy("relation").agg(F.sum("n").alias("n"))


@query(sql.ask("SELECT scanner_id, variant_id, occurrence_id, f_start, f_end, f_family, f_jurisdiction, f_sensitive, f_action FROM ranked WHERE rn = 1", (sql.MATRIX, sql.PAIRS, sql.RANKED)))
def primary_finding(spark: SparkSession, d: str) -> DataFrame:
    p = Of(spark, d)
    rows = matching.primaries(matching.candidates(p.expectations, matching.of_complete(p.findings, p.scanners)))
    return rows.select("scanner_id", "variant_id", "occurrence_id", *["p." + c for c in ("f_start", "f_end", "f_family", "f_jurisdiction", "f_sensitive", "f_action")])


@query(sql.ask(f"SELECT {_AXES}, action, finding_count, families, jurisdictions FROM outcomes", sql.ASSESSED))
def outcome_matrix(spark: SparkSession, d: str) -> DataFrame:
    return Of(spark, d).outcomes(observed=True).select(*AXES, "action", "finding_count", *[F.when(F.col("status") == "complete", F.col(c)).otherwise("").alias(c) for c in ("families", "jurisdictions")])


def _histogram(axis: str) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        return Of(spark, d).outcomes().groupBy("scanner_id", "method", axis).agg(F.count("*").alias("n"))

    run.__name__ = axis.replace("_state", "_axis")
    query(sql.ask(f"SELECT scanner_id, method, {axis}, count(*) AS n FROM outcomes GROUP BY ALL", sql.ASSESSED))(run)


for _axis in STATES:
    _histogram(_axis)


@query(sql.ask("SELECT scanner_id, variant_id, occurrence_id, n, families, jurisdictions FROM seen", (sql.MATRIX, sql.PAIRS, sql.RANKED, sql.SEEN)))
def observed_summary(spark: SparkSession, d: str) -> DataFrame:
    p = Of(spark, d)
    return matching.primaries(matching.candidates(p.expectations, matching.of_complete(p.findings, p.scanners))).drop("p")


_REPORTED = """SELECT f.scanner_id, f.variant_id, f.emission, f.f_start, f.f_end, e.occurrence_id,
  CASE WHEN exp_start IS NULL THEN NULL WHEN f_start = exp_start AND f_end = exp_end THEN 0 WHEN f_start <= exp_start AND f_end >= exp_end THEN 1 ELSE 2 END AS rank,
  CASE WHEN f_start = exp_start AND f_end = exp_end THEN 0 WHEN f_start <= exp_start AND f_end >= exp_end THEN (f_end - f_start) - (exp_end - exp_start)
    ELSE (exp_end - exp_start) - (least(exp_end, f_end) - greatest(exp_start, f_start)) END AS tight
FROM findings f LEFT JOIN expectations e ON f.variant_id = e.variant_id AND exp_start < f_end AND f_start < exp_end"""
_BEST = ("best", f"SELECT * FROM ({_REPORTED}) QUALIFY row_number() OVER (PARTITION BY scanner_id, variant_id, emission, f_start, f_end ORDER BY rank, tight, occurrence_id) = 1")


@query(sql.ask("SELECT scanner_id, variant_id, emission, f_start, f_end, occurrence_id FROM best WHERE occurrence_id IS NOT NULL", (_BEST,)))
def reported_spans(spark: SparkSession, d: str) -> DataFrame:
    p = Of(spark, d)
    return matching.reported(p.expectations, p.findings).select("scanner_id", "variant_id", "emission", "f_start", "f_end", F.col("best.occurrence_id").alias("occurrence_id"))


@query(sql.ask("SELECT scanner_id, variant_id, emission, f_start, f_end FROM findings f WHERE NOT EXISTS (SELECT 1 FROM expectations e WHERE e.variant_id = f.variant_id AND exp_start < f_end AND f_start < exp_end)", ()))
def unmatched_findings(spark: SparkSession, d: str) -> DataFrame:
    p = Of(spark, d)
    return matching.unmatched(p.expectations, p.findings).select("scanner_id", "variant_id", "emission", "f_start", "f_end")


@query(sql.ask(f"SELECT {_AXES} FROM outcomes WHERE text_negative", sql.ASSESSED))
def text_negative_rows(spark: SparkSession, d: str) -> DataFrame:
    return Of(spark, d).outcomes().where("text_negative").select(*AXES)


@query(sql.ask(f"SELECT {_AXES} FROM outcomes WHERE exp_start IS NULL AND NOT text_negative", sql.ASSESSED))
def rangeless_rows(spark: SparkSession, d: str) -> DataFrame:
    return Of(spark, d).outcomes().where("exp_start is null and not text_negative").select(*AXES)


@query(sql.ask(f"SELECT {', '.join(KEYS)}, CASE WHEN case_id % 13 = 0 THEN 'not-measured' ELSE type_state END AS type_state FROM outcomes", sql.ASSESSED))
def review_gated_rows(spark: SparkSession, d: str) -> DataFrame:
    p = Of(spark, d)
    return matching.gated(p.outcomes(), p.variants.where("case_id % 13 = 0")).select(*KEYS, "type_state")


@query(sql.ask(f"SELECT {_AXES} FROM outcomes WHERE type_state = 'not-measured' AND sensitivity_state = 'not-measured' AND range_state = 'not-applicable' AND action_state = 'not-measured'", sql.ASSESSED))
def unmeasured_scanner_rows(spark: SparkSession, d: str) -> DataFrame:
    return Of(spark, d).outcomes().where(verify.is_unmeasured()).select(*AXES)


_STANDINGS = ", ".join(f"coalesce({name}, -1) AS {name}" for name in accounting.STANDINGS)


@query(sql.ask(f"SELECT scanner_id, case_id, {_STANDINGS} FROM folded", (*sql.ASSESSED, sql.FOLDED)))
def case_flags(spark: SparkSession, d: str) -> DataFrame:
    """Each case's standing in each metric, -1 where the metric does not look at it."""
    return Of(spark, d).cases_folded().select("scanner_id", "case_id", *[F.coalesce(F.col(c).cast("int"), F.lit(-1)).alias(c) for c in accounting.STANDINGS])


@query(sql.ask("SELECT scanner_id, metric, bucket, count(*) AS n FROM bucketed WHERE bucket IS NOT NULL GROUP BY ALL", (*sql.ASSESSED, sql.FOLDED, sql.BUCKETED)))
def metric_buckets(spark: SparkSession, d: str) -> DataFrame:
    rows = Of(spark, d).bucketed()
    return rows.groupBy("scanner_id", "metric", "bucket").agg(accounting.number(rows).alias("n"))


def _by(stratum: str) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        counts = accounting.tallies(Of(spark, d).bucketed())
        return counts.where(F.col("stratum") == stratum).select(*METRIC, "value")

    run.__name__ = "metric_counts_overall" if stratum == "overall" else f"metric_counts_by_{stratum}"
    query(sql.ask(f"SELECT {_METRIC}, value FROM tallied WHERE stratum = '{stratum}'"))(run)


for _stratum in ("overall", *accounting.STRATA):
    _by(_stratum)


@query(sql.ask("SELECT scanner_id, metric, stratum, value, n, status, value_state, coalesce(point, -1) AS point, coalesce(bound, -1) AS bound FROM published"))
def metric_published(spark: SparkSession, d: str) -> DataFrame:
    """Withheld values are shown as -1."""
    shown = [F.coalesce(c, F.lit(-1)).alias(c) for c in ("point", "bound")]
    return Of(spark, d).metrics().select("scanner_id", "metric", "stratum", "value", "n", "status", "value_state", *shown)


@query(sql.ask("SELECT o.scanner_id, o.stratum, o.value, count(DISTINCT case_id) AS cases, count(DISTINCT variant_id) AS variants, count(*) AS occurrences FROM (SELECT *, 'method' AS stratum, method AS value FROM outcomes UNION ALL SELECT *, 'language', language FROM outcomes) o GROUP BY ALL", sql.ASSESSED))
def metric_basis(spark: SparkSession, d: str) -> DataFrame:
    pair = lambda s: F.struct(F.lit(s).alias("stratum"), F.col(s).alias("value"))
    rows = Of(spark, d).every().select("scanner_id", "case_id", "variant_id", F.explode(F.array(pair("method"), pair("language"))).alias("s"))
    return rows.groupBy("scanner_id", "s.stratum", "s.value").agg(F.countDistinct("case_id").alias("cases"), F.countDistinct("variant_id").alias("variants"), F.count("*").alias("occurrences"))


@query(sql.ask("SELECT m.scanner_id, m.metric, CASE s.status WHEN 'unstable' THEN 'unstable-replays' ELSE 'scanner-incomplete' END AS cause FROM published m JOIN scanners s USING (scanner_id) WHERE m.stratum = 'overall' AND m.status = 'not-measured' AND s.status <> 'complete'"))
def not_measured_cause(spark: SparkSession, d: str) -> DataFrame:
    p = Of(spark, d)
    m = p.metrics().where("stratum = 'overall' and status = 'not-measured'").select("scanner_id", "metric")
    cause = F.when(F.col("status") == "unstable", "unstable-replays").otherwise("scanner-incomplete")
    return m.join(F.broadcast(p.scanners), "scanner_id").where("status <> 'complete'").select("scanner_id", "metric", cause.alias("cause"))


@query(sql.ask("SELECT method, count(DISTINCT case_id) AS cases, count(*) AS variants FROM variants GROUP BY ALL", ()))
def method_coverage(spark: SparkSession, d: str) -> DataFrame:
    return Of(spark, d).variants.groupBy("method").agg(F.countDistinct("case_id").alias("cases"), F.count("*").alias("variants"))


@query(sql.ask("SELECT count(DISTINCT case_id) AS cases, count(DISTINCT variant_id) AS variants, count(*) AS occurrences FROM expectations", ()))
def population_counts(spark: SparkSession, d: str) -> DataFrame:
    return Of(spark, d).expectations.agg(F.countDistinct("case_id").alias("cases"), F.countDistinct("variant_id").alias("variants"), F.count("*").alias("occurrences"))


_VIEW = "CASE WHEN case_id % 5 = 0 THEN 'benign' WHEN case_id % 5 < 3 THEN 'core' ELSE 'extended' END"


@query(sql.ask(f"SELECT {_VIEW} AS view, count(DISTINCT case_id) AS cases, count(DISTINCT variant_id) AS variants, count(*) AS occurrences, count(*) FILTER (sensitivity = 'sensitive') AS sensitive, count(*) FILTER (sensitivity = 'non-sensitive') AS non_sensitive, count(*) FILTER (sensitivity = 'not-established') AS not_established FROM expectations GROUP BY ALL", ()))
def view_composition(spark: SparkSession, d: str) -> DataFrame:
    count = lambda s: F.count_if(F.col("sensitivity") == s).alias(s.replace("-", "_"))
    rows = Of(spark, d).expectations.groupBy(F.expr(_VIEW).alias("view"))
    return rows.agg(F.countDistinct("case_id").alias("cases"), F.countDistinct("variant_id").alias("variants"), F.count("*").alias("occurrences"), count("sensitive"), count("non-sensitive"), count("not-established"))


@query(sql.ask(f"SELECT b.scanner_id, {_VIEW.replace('case_id', 'b.case_id')} AS view, c.family, b.metric, {sql._COUNTS} FROM bucketed b JOIN cases c USING (case_id) WHERE bucket IS NOT NULL GROUP BY ALL", (*sql.ASSESSED, sql.FOLDED, sql.BUCKETED)))
def projection_cells(spark: SparkSession, d: str) -> DataFrame:
    of = ("view", "family")
    rows = accounting.buckets(accounting.alike(Of(spark, d).cases_folded(("family",)).withColumn("view", F.expr(_VIEW)), of), of)
    cells = rows.groupBy("scanner_id", *of, "metric", "bucket").agg(accounting.number(rows).alias("n"))
    total = lambda name, *of: F.sum(F.when(F.col("bucket").isin(*of), F.col("n")).otherwise(0)).alias(name)
    return cells.groupBy("scanner_id", "view", "family", "metric").agg(total("eligible", "numerator", "other", "unresolved", "not-measured"), total("measured", "numerator", "other"), *[total(b.replace("-", "_"), b) for b in ("numerator", "unresolved", "not-measured", "not-applicable")], F.sum("n").alias("total"))


@query(sql.ask(f"SELECT {', '.join(KEYS)} FROM outcomes WHERE case_id % 17 = 0", sql.ASSESSED))
def missing_rows(spark: SparkSession, d: str) -> DataFrame:
    p = Of(spark, d)
    return verify.missing(p.every(), p.outcomes().where("case_id % 17 <> 0")).select(*KEYS)


@query(sql.ask(f"SELECT {', '.join(KEYS)}, CAST(2 AS BIGINT) AS n FROM outcomes WHERE case_id % 19 = 0", sql.ASSESSED))
def duplicate_rows(spark: SparkSession, d: str) -> DataFrame:
    rows = Of(spark, d).outcomes().select(*KEYS)
    return verify.duplicates(rows.union(rows.where("case_id % 19 = 0")), KEYS)


#: Outcomes with faults in four axes, as SQL that Spark and DuckDB read alike.
_FAULTS = {
    "type_state": "CASE WHEN case_id % 23 = 0 THEN 'wrong-family' ELSE type_state END",
    "sensitivity_state": "CASE WHEN case_id % 31 = 0 THEN 'false-positive' ELSE sensitivity_state END",
    "range_state": "CASE WHEN case_id % 29 = 0 THEN 'unresolved' ELSE range_state END",
    "action_state": "CASE WHEN case_id % 37 = 0 THEN 'reported' ELSE action_state END",
}
_LATTICE = """CASE WHEN CASE WHEN exp_start IS NOT NULL THEN range_state = 'unresolved' ELSE range_state NOT IN ('unresolved', 'not-applicable') END THEN 'range-contradiction'
  WHEN type_state NOT IN ('not-measured', 'unresolved') AND type_expectation = 'not-established' OR type_state = 'unresolved' AND type_expectation <> 'not-established' THEN 'unreachable-type'
  WHEN type_state IN ('correct', 'miss', 'wrong-family', 'wrong-jurisdiction') AND type_expectation <> 'valid' THEN 'unreachable-type'
  WHEN type_state IN ('invalid-correct', 'invalid-accepted') AND type_expectation <> 'invalid' THEN 'unreachable-type'
  WHEN sensitivity_state = 'unresolved' AND sensitivity IN ('sensitive', 'non-sensitive') OR sensitivity_state IN ('correct', 'miss', 'false-positive') AND sensitivity = 'not-established'
    OR sensitivity_state = 'miss' AND sensitivity <> 'sensitive' OR sensitivity_state = 'false-positive' AND sensitivity <> 'non-sensitive' THEN 'unreachable-sensitivity'
  WHEN status <> 'complete' AND (type_state <> 'not-measured' OR sensitivity_state <> 'not-measured' OR range_state <> 'not-applicable' OR action_state <> 'not-measured') THEN 'measured-by-incomplete-scanner'
  WHEN (cap_family = 'unsupported' OR family_state = 'unsupported' OR place_state = 'unsupported') AND type_state <> 'not-measured' THEN 'measured-unsupported-type'
  WHEN cap_ranges = 'unsupported' AND range_state <> 'not-applicable' OR cap_sensitivity = 'unsupported' AND sensitivity_state <> 'not-measured'
    OR cap_jurisdiction = 'unsupported' AND type_state = 'wrong-jurisdiction' OR action_state IN ('reported', 'no-action-reported') AND cap_action = 'unavailable' THEN 'capability-contradiction' END"""
_BROKEN = ("broken", "SELECT * REPLACE (" + ", ".join(f"{e} AS {c}" for c, e in _FAULTS.items()) + ") FROM outcomes")


@query(sql.ask(f"SELECT * FROM (SELECT {', '.join(KEYS)}, {_LATTICE} AS code FROM broken) WHERE code IS NOT NULL", (*sql.ASSESSED, _BROKEN)))
def lattice_violations(spark: SparkSession, d: str) -> DataFrame:
    broken = Of(spark, d).outcomes().withColumns({c: F.expr(e) for c, e in _FAULTS.items()})
    return verify.lattice(broken).select(*KEYS, "code")


@query(sql.ask("SELECT DISTINCT scanner_id, variant_id FROM findings WHERE case_id % 29 = 0", ()))
def unknown_occurrences(spark: SparkSession, d: str) -> DataFrame:
    p = Of(spark, d)
    return p.findings.join(p.variants.where("case_id % 29 <> 0"), "variant_id", "left_anti").select("scanner_id", "variant_id").distinct()


@query(sql.ask("SELECT case_id, language, jurisdiction FROM cases WHERE language NOT IN ('en', 'ko') OR (jurisdiction IS NOT NULL AND jurisdiction <> 'US')", ()))
def scope_violations(spark: SparkSession, d: str) -> DataFrame:
    return verify.outside(Of(spark, d).cases, languages=["en", "ko"], jurisdictions=["US"]).select("case_id", "language", "jurisdiction")


@query(sql.ask("SELECT scanner_id, metric, numerator + 1 AS stored, numerator AS recomputed FROM tallied WHERE stratum = 'overall' AND metric = 'type-miss-rate'"))
def metric_recompute_diff(spark: SparkSession, d: str) -> DataFrame:
    now = accounting.tallies(Of(spark, d).bucketed()).where("stratum = 'overall'").select("scanner_id", "metric", "numerator")
    now = staging.kept(now, "metrics")
    then = now.withColumn("numerator", F.col("numerator") + F.when(F.col("metric") == "type-miss-rate", 1).otherwise(0))
    return verify.changed(then, now, ["scanner_id", "metric"], "numerator")


_PAIR = """SELECT metric, CASE WHEN a.value_state <> 'published' AND b.value_state <> 'published' THEN 'withheld-in-both' WHEN a.value_state <> 'published' THEN 'withheld-in-base'
  WHEN b.value_state <> 'published' THEN 'withheld-in-other' WHEN a.point = b.point AND a.bound = b.bound THEN 'identical' ELSE 'changed' END AS relation
FROM (SELECT * FROM published WHERE scanner_id = 0 AND stratum = 'overall') a JOIN (SELECT * FROM published WHERE scanner_id = 3 AND stratum = 'overall') b USING (metric)"""


@query(sql.ask(_PAIR))
def compare_metrics(spark: SparkSession, d: str) -> DataFrame:
    m = Of(spark, d).kept_metrics().where("stratum = 'overall'")
    return compare.relations(m.where("scanner_id = 0"), m.where("scanner_id = 3"), ["metric"])


_FIELDS = ["status", "cap_family", "cap_sensitivity", "version"]


@query(sql.ask(" UNION ALL ".join(f"SELECT scanner_id, '{f}' AS field, a.{f} AS base, b.{f} AS other FROM earlier a FULL JOIN later b USING (scanner_id) WHERE a.{f} IS DISTINCT FROM b.{f}" for f in _FIELDS), ()))
def compare_identity_changes(spark: SparkSession, d: str) -> DataFrame:
    """What the scanners of two runs declare differently."""
    p = Of(spark, d)
    return compare.changed_fields(p.earlier, p.later, _FIELDS, "scanner_id")


@query(sql.ask("SELECT scanner_id, count(*) AS inputs, count(*) FILTER (scanner_id = 3 AND variant_id % 7 = 0) AS differing FROM (SELECT DISTINCT scanner_id, variant_id FROM findings) GROUP BY ALL", ()))
def replay_stability(spark: SparkSession, d: str) -> DataFrame:
    f = Of(spark, d).findings
    again = f.withColumn("f_end", F.col("f_end") + F.when((F.col("scanner_id") == 3) & (F.col("variant_id") % 7 == 0), 1).otherwise(0))
    return compare.stability(f, again)


_LEGACY = (
    "legacy",
    """SELECT m.scanner_id, m.variant_id, m.occurrence_id, m.case_id, m.method, CASE WHEN r.emission IS NULL THEN 'miss' WHEN r.f_family IS NULL OR r.f_family <> m.family THEN 'wrong-family'
  WHEN m.jurisdiction IS NOT NULL AND (r.f_jurisdiction IS NULL OR r.f_jurisdiction <> m.jurisdiction) THEN 'wrong-jurisdiction' ELSE 'correct' END AS legacy_type, coalesce(r.f_sensitive, FALSE) AS legacy_flag
FROM mat m LEFT JOIN (SELECT * FROM pairs QUALIFY row_number() OVER (PARTITION BY scanner_id, variant_id, occurrence_id ORDER BY emission, f_start, f_end, f_family NULLS FIRST, f_jurisdiction NULLS FIRST, f_sensitive NULLS FIRST) = 1) r
  USING (scanner_id, variant_id, occurrence_id) WHERE m.status = 'complete' AND m.exp_start IS NOT NULL""",
)


@query(sql.ask("SELECT scanner_id, variant_id, occurrence_id, legacy_type, legacy_flag FROM legacy", (sql.MATRIX, sql.PAIRS, _LEGACY)))
def legacy_outcomes(spark: SparkSession, d: str) -> DataFrame:
    p = Of(spark, d)
    return matching.first_overlap(p.expectations, p.findings, p.scanners).drop("case_id", "method")


@query(sql.ask("SELECT scanner_id, method, count(*) AS cases, count(*) FILTER (any_pass) AS any_pass, count(*) FILTER (all_pass) AS all_pass FROM (SELECT scanner_id, case_id, method, bool_or(legacy_type = 'correct') AS any_pass, bool_and(legacy_type = 'correct') AS all_pass FROM legacy GROUP BY ALL) GROUP BY ALL", (sql.MATRIX, sql.PAIRS, _LEGACY)))
def legacy_metric_counts(spark: SparkSession, d: str) -> DataFrame:
    p = Of(spark, d)
    good = F.col("legacy_type") == "correct"
    rows = matching.first_overlap(p.expectations, p.findings, p.scanners).groupBy("scanner_id", "case_id", "method").agg(F.bool_or(good).alias("any"), F.bool_and(good).alias("all"))
    return rows.groupBy("scanner_id", "method").agg(F.count("*").alias("cases"), F.count_if("any").alias("any_pass"), F.count_if("all").alias("all_pass"))


@query(sql.ask("SELECT type_state, legacy_type, count(*) AS n FROM outcomes JOIN legacy USING (scanner_id, variant_id, occurrence_id) WHERE type_state <> legacy_type GROUP BY ALL", (*sql.ASSESSED, _LEGACY)))
def legacy_vs_canonical_diff(spark: SparkSession, d: str) -> DataFrame:
    p = Of(spark, d)
    old = matching.first_overlap(p.expectations, p.findings, p.scanners).drop("case_id", "method")
    rows = p.outcomes().join(old, ["scanner_id", "variant_id", "occurrence_id"])
    return rows.where("type_state <> legacy_type").groupBy("type_state", "legacy_type").agg(F.count("*").alias("n"))


_SSN = "lpad(CAST(o_orderkey * 7919 % 1000 AS VARCHAR), 3, '0') || '-' || lpad(CAST(o_custkey % 100 AS VARCHAR), 2, '0') || '-' || lpad(CAST(o_orderkey % 10000 AS VARCHAR), 4, '0')"
_MOD = "'SYNTHETIC-' || lpad(CAST(o_orderkey % 10000 AS VARCHAR), 4, '0')"


def _values(spark: SparkSession, d: str) -> DataFrame:
    o = spark.read.parquet(f"{d}/orders.parquet")
    pad = lambda c, n: F.lpad(c.cast("string"), n, "0")
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    return o.select(k.alias("case_id"), F.concat(pad(k * 7919 % 1000, 3), F.lit("-"), pad(c % 100, 2), F.lit("-"), pad(k % 10000, 4)).alias("ssn"), F.concat(F.lit("SYNTHETIC-"), pad(k % 10000, 4)).alias("mod10"))


def _ssn_state(value: str) -> str:
    return f"""CASE WHEN regexp_full_match({value}, '[0-9]{{9}}') AND substr({value}, 1, 3) NOT IN ('000', '666') AND substr({value}, 1, 1) <> '9'
  AND substr({value}, 4, 2) <> '00' AND substr({value}, 6, 4) <> '0000' THEN 'valid' ELSE 'invalid' END"""


@query(f"""SELECT case_id, ssn, digits, mod10, {_ssn_state("ssn")} AS ssn_state, {_ssn_state("digits")} AS digits_state,
  CASE WHEN (substr(mod10, 11, 1)::INT + substr(mod10, 12, 1)::INT + substr(mod10, 13, 1)::INT) % 10 = substr(mod10, 14, 1)::INT THEN 'valid' ELSE 'invalid' END AS mod10_state, 'unavailable' AS unknown_state
FROM (SELECT o_orderkey AS case_id, {_SSN} AS ssn, replace({_SSN}, '-', '') AS digits, {_MOD} AS mod10 FROM orders)""")
def validator_observations(spark: SparkSession, d: str) -> DataFrame:
    """A number written with hyphens is invalid; its digits alone may be valid."""
    see = lambda v, n, c: identity.observe(F.lit(v), F.lit(n), F.col(c))
    rows = _values(spark, d).select("case_id", "ssn", F.regexp_replace("ssn", "-", "").alias("digits"), "mod10")
    return rows.select("*", see("us-ssn-allocation", 1, "ssn").alias("ssn_state"), see("us-ssn-allocation", 1, "digits").alias("digits_state"), see("synthetic-mod10", 1, "mod10").alias("mod10_state"), see("synthetic-mod10", 2, "mod10").alias("unknown_state"))


@query(f"SELECT case_id, ssn, substr(ssn, 1, 10) || CAST((substr(ssn, 11, 1)::INT + 1) % 10 AS VARCHAR) AS mutated FROM (SELECT o_orderkey AS case_id, {_SSN} AS ssn FROM orders)")
def mutation_variants(spark: SparkSession, d: str) -> DataFrame:
    return _values(spark, d).select("case_id", "ssn", identity.invalidate_final_digit(F.col("ssn")).alias("mutated"))


@query(f"""SELECT case_id, slot, replace(template, '{{{{candidate}}}}', ssn) AS text, CAST(strlen(split_part(template, '{{{{candidate}}}}', 1)) AS BIGINT) AS start, context_class
FROM (SELECT o_orderkey AS case_id, {_SSN} AS ssn FROM orders), (VALUES ('frame-0', 'Employee number: {{{{candidate}}}}.', 'sensitive'), ('frame-1', 'Größe {{{{candidate}}}} cm', 'neutral'), ('frame-2', 'sample {{{{candidate}}}}', 'non-sensitive')) t(slot, template, context_class)""")
def context_frames(spark: SparkSession, d: str) -> DataFrame:
    return generate.frames(_values(spark, d).withColumnRenamed("ssn", "value")).select("case_id", "slot", "text", "start", "context_class")


@query("SELECT 'slot-' || (o_orderkey % 3) AS slot, o_orderkey AS case_id, sha256('case-' || o_orderkey) AS digest FROM orders")
def sha_ids(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    return spark.read.parquet(f"{d}/orders.parquet").select(F.concat(F.lit("slot-"), k % 3).alias("slot"), k.alias("case_id"), F.sha2(F.concat(F.lit("case-"), k), 256).alias("digest"))


#: Bytes that a text may have in the generation queries.
_LIMIT = 4096
_GEN = """SELECT case_id, method, CASE WHEN case_id % 31 = 0 THEN 'text-too-large' WHEN exp_start IS NULL THEN 'range-invalid' WHEN method = 'jurisdiction-collision' AND case_id % 2 = 0 THEN 'invalid-collision'
  WHEN method = 'pii-benign' AND sensitivity <> 'non-sensitive' THEN 'not-non-sensitive' END AS reason FROM expectations WHERE occurrence_id = 0 AND variant_id % 10 = 0"""


def _authored(spark: SparkSession, d: str) -> DataFrame:
    """One case a row with what the guards read. The faults are in the rows: texts over the limit and empty competing sets."""
    rows = Of(spark, d).expectations.where("occurrence_id = 0 and variant_id % 10 = 0")
    none = F.lit(None).cast("string")
    others = F.array_remove(F.array(*map(F.lit, generate.FAMILIES)), F.col("family"))
    scope = F.coalesce(F.lower("jurisdiction"), F.lit("global"))
    scoped = lambda name: F.concat(F.lit("pii:"), scope, F.lit(":"), name)
    rivals = F.when(F.col("case_id") % 2 == 0, F.array().cast("array<string>")).otherwise(F.transform(others, scoped))
    rows = rows.withColumn("competing", F.when(F.col("method") == "jurisdiction-collision", rivals)).withColumn("family", scoped(F.col("family")))
    rows = rows.withColumn("text", F.repeat(F.lit("x"), F.when(F.col("case_id") % 31 == 0, _LIMIT + 1).otherwise(64)))
    rows = rows.withColumn("evidence_method", none).withColumn("benign_class", none).withColumn("evidence_classes", F.lit(None).cast("array<string>"))
    return rows.withColumn("cross_family", F.lit(False)).withColumn("checks", F.lit(None).cast("array<struct<validator:string,version:int,expected:string>>"))


@query(sql.ask("SELECT method, count(*) AS given, count(*) FILTER (reason IS NULL) AS generated, count(reason) AS refused FROM g GROUP BY ALL", (("g", _GEN),)))
def generation_report(spark: SparkSession, d: str) -> DataFrame:
    rows = generate.guarded(_authored(spark, d), _LIMIT)
    return rows.groupBy("method").agg(F.count("*").alias("given"), F.count_if(F.col("reason").isNull()).alias("generated"), F.count("reason").alias("refused"))


@query(sql.ask("SELECT case_id, method, reason FROM g WHERE reason IS NOT NULL", (("g", _GEN),)))
def generation_refusals(spark: SparkSession, d: str) -> DataFrame:
    return generate.guarded(_authored(spark, d), _LIMIT).where("reason is not null").select("case_id", "method", "reason")


@query(sql.ask("SELECT case_id, family AS target, array_to_string([x FOR x IN ['card', 'email', 'phone', 'ssn'] IF x <> family], ',') AS competing FROM cases WHERE method = 'jurisdiction-collision'", ()))
def collision_cases(spark: SparkSession, d: str) -> DataFrame:
    return generate.collisions(Of(spark, d).cases.where("method = 'jurisdiction-collision'"))


@query("""SELECT doc_id, CAST(strlen(array_to_string(parts[1:i], '')) + strlen(array_to_string(runs[1:i - 1], '')) AS BIGINT) AS start,
  CAST(strlen(array_to_string(parts[1:i], '')) + strlen(array_to_string(runs[1:i], '')) AS BIGINT) AS end_, runs[i] AS token
FROM (SELECT *, unnest(range(1, len(runs) + 1)) AS i FROM (SELECT doc_id, regexp_extract_all(text, '[0-9]{3,}') AS runs, regexp_split_to_array(text, '[0-9]{3,}') AS parts FROM documents))""")
def byte_ranges_documents(spark: SparkSession, d: str) -> DataFrame:
    """Every digit run of each text."""
    rows = spark.read.parquet(f"{d}/documents.parquet")
    return ranges.every_match(rows.select("doc_id", "text"), "text", "[0-9]{3,}").select("doc_id", "start", "end_", "token")


_AT = "(CASE WHEN {0} < strlen(text) THEN ('0x' || substr(hex(encode(text)), CAST(2 * {0} + 1 AS BIGINT), 2))::INT & 192 ELSE 0 END) = 128"


@query(f"""SELECT doc_id, CASE WHEN s > e THEN 'inverted' WHEN s = e THEN 'empty' WHEN e > strlen(text) THEN 'out-of-bounds' WHEN {_AT.format("s")} OR {_AT.format("e")} THEN 'not-a-boundary' END AS defect
FROM (SELECT doc_id, text, doc_id % 50 AS s, doc_id % 37 + 10 AS e FROM documents) WHERE defect IS NOT NULL""")
def range_validation(spark: SparkSession, d: str) -> DataFrame:
    defect = ranges.range_error(F.col("text"), F.col("doc_id") % 50, F.col("doc_id") % 37 + 10)
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", defect.alias("defect")).where("defect is not null")


@query("SELECT doc_id, CAST(strlen(text) AS BIGINT) AS utf8, CAST(length(text) + length(regexp_replace(text, '[\\x{0}-\\x{FFFF}]', '', 'g')) AS BIGINT) AS utf16, CAST(length(text) AS BIGINT) AS points FROM documents")
def utf16_lengths(spark: SparkSession, d: str) -> DataFrame:
    utf8, utf16, points = ranges.unit_lengths(F.col("text"))
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", utf8.alias("utf8"), utf16.alias("utf16"), points.alias("points"))


@query(sql.ask("""SELECT variant_id, min(f_start) AS s, max(f_end) AS e, count(*) AS n FROM (SELECT *, sum(fresh) OVER (PARTITION BY variant_id ORDER BY f_start, f_end, fresh DESC ROWS UNBOUNDED PRECEDING) AS island
  FROM (SELECT variant_id, f_start, f_end, CASE WHEN f_start <= max(f_end) OVER (PARTITION BY variant_id ORDER BY f_start, f_end ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM findings)) GROUP BY variant_id, island""", ()))
def merged_ranges(spark: SparkSession, d: str) -> DataFrame:
    return compare.islands(Of(spark, d).findings, "variant_id", "f_start", "f_end")


@query("SELECT event_type, count(*) AS n, median(value) AS median, mad(value) AS mad, min(value) AS least, max(value) AS most FROM events GROUP BY ALL")
def trial_summary_mad(spark: SparkSession, d: str) -> DataFrame:
    return compare.trials(spark.read.parquet(f"{d}/events.parquet"), "event_type", "value")


@query("SELECT p_brand, round(regr_slope(ln(p_retailprice), ln(p_size)), 6) AS slope FROM part WHERE p_size > 0 AND p_retailprice > 0 GROUP BY ALL")
def loglog_slope(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.read.parquet(f"{d}/part.parquet").where("p_size > 0 and p_retailprice > 0")
    return rows.groupBy("p_brand").agg(F.round(F.regr_slope(F.log("p_retailprice"), F.log("p_size")), 6).alias("slope"))


@query(sql.ask("SELECT language, method, count(*) AS cases, count(jurisdiction) AS placed FROM cases GROUP BY ALL", ()))
def population_composition_side_by_side(spark: SparkSession, d: str) -> DataFrame:
    return Of(spark, d).cases.groupBy("language", "method").agg(F.count("*").alias("cases"), F.count("jurisdiction").alias("placed"))


@query("""SELECT l_orderkey AS case_id, CAST(l_linenumber AS BIGINT) AS emission, 'finding-without-variant' AS code FROM lineitem l WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_orderkey = l.l_orderkey)
UNION ALL SELECT o_orderkey, NULL, 'case-without-finding' FROM orders o WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey)""")
def reference_integrity(spark: SparkSession, d: str) -> DataFrame:
    """Raw findings without a variant, and cases without a finding."""
    p = Of(spark, d)
    raw = p.lineitem.select(F.col("l_orderkey").alias("case_id"), F.col("l_linenumber").cast("long").alias("emission"))
    dangling = raw.join(p.variants.select("case_id"), "case_id", "left_anti").select("case_id", "emission", F.lit("finding-without-variant").alias("code"))
    silent = p.cases.join(raw, "case_id", "left_anti").select("case_id", F.lit(None).cast("long").alias("emission"), F.lit("case-without-finding").alias("code"))
    return dangling.union(silent)


@query(sql.ask("SELECT family, count(DISTINCT case_id) AS cases, count(*) AS fixtures, string_agg(DISTINCT method, ',' ORDER BY method) AS methods FROM expectations GROUP BY ALL", ()))
def evidence_coverage(spark: SparkSession, d: str) -> DataFrame:
    methods = F.array_join(F.array_sort(F.collect_set("method")), ",")
    return Of(spark, d).expectations.groupBy("family").agg(F.countDistinct("case_id").alias("cases"), F.count("*").alias("fixtures"), methods.alias("methods"))


@query("""WITH RECURSIVE e AS (SELECT user_id, event_type, ts, event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS rn FROM events),
k AS (SELECT user_id, event_type, ts, event_id, rn, ts AS kept, TRUE AS keep FROM e WHERE rn = 1
  UNION ALL SELECT e.user_id, e.event_type, e.ts, e.event_id, e.rn, CASE WHEN e.ts >= k.kept + INTERVAL 1 DAY THEN e.ts ELSE k.kept END, e.ts >= k.kept + INTERVAL 1 DAY FROM k JOIN e ON e.user_id = k.user_id AND e.event_type = k.event_type AND e.rn = k.rn + 1)
SELECT event_id, user_id, event_type FROM k WHERE keep""")
def delivery_dedupe(spark: SparkSession, d: str) -> DataFrame:
    from ..streaming.dedupe import first_within

    return first_within(spark.read.parquet(f"{d}/events.parquet"), ["user_id", "event_type"], "ts", "event_id", 86_400).select("event_id", "user_id", "event_type")


@query("SELECT CAST(labels.quality AS BIGINT) AS quality, CAST(labels.toxic AS BIGINT) AS toxic, count(*) AS n, count(*) FILTER (lower(text) LIKE '%idiot%') AS flagged FROM labels JOIN documents USING (doc_id) GROUP BY ALL")
def document_level_flags(spark: SparkSession, d: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels"))
    flagged = docs.select("doc_id", F.lower("text").contains("idiot").alias("hit"))
    return labels.join(flagged, "doc_id").groupBy(F.col("quality").cast("long").alias("quality"), F.col("toxic").cast("long").alias("toxic")).agg(F.count("*").alias("n"), F.count_if("hit").alias("flagged"))

#: Plain SQL that Spark and DuckDB read alike.
_DOCUMENTS = """SELECT c_custkey, CASE c_custkey % 12 WHEN 0 THEN '{"id":' || c_custkey || ',"name":["' || c_name || '"]}' WHEN 1 THEN '{"id":1,"id":' || c_custkey || '}'
  WHEN 2 THEN '{"id":null}' WHEN 3 THEN '{"id":1.5}' WHEN 4 THEN '{"id":9007199254740992}' WHEN 5 THEN repeat('[', 33) || repeat(']', 33) WHEN 6 THEN '{"id":1} 2'
  WHEN 7 THEN '{"a":[{"DetectorState":1}]}' WHEN 8 THEN '' WHEN 9 THEN '[-0]' WHEN 10 THEN repeat('[', 32) || repeat(']', 32) ELSE '{"name":"score"}' END AS document FROM customer"""


@query("""SELECT c_custkey, CASE c_custkey % 12 WHEN 1 THEN 'duplicate-key' WHEN 2 THEN 'null-not-allowed' WHEN 3 THEN 'float-not-allowed' WHEN 4 THEN 'integer-out-of-range'
  WHEN 5 THEN 'nesting-too-deep' WHEN 6 THEN 'malformed-json' WHEN 8 THEN 'malformed-json' WHEN 9 THEN 'float-not-allowed' END AS defect, c_custkey % 12 = 7 AS banned FROM customer""")
def strict_json_defects(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.sql(_DOCUMENTS.replace("FROM customer", f"FROM parquet.`{d}/customer.parquet`"))
    return rows.select("c_custkey", exchange.strict_json(F.col("document")).alias("found")).select("c_custkey", "found.defect", "found.banned")


_ENVELOPES = """SELECT c_custkey, CASE c_custkey % 8 WHEN 0 THEN '[1]' WHEN 1 THEN '{"id":1}' WHEN 2 THEN '{"schema":"x"}' WHEN 3 THEN '{"schema":"manifest","schemaVersion":"1.0"}'
  WHEN 4 THEN '{"schema":"corpus","schemaVersion":"1.00"}' WHEN 5 THEN '{"schema":"corpus","schemaVersion":"2.0"}' WHEN 6 THEN '{"schema":"corpus","schemaVersion":"1.3"}'
  ELSE '{"schema":"corpus","schemaVersion":"1.1"}' END AS document FROM customer"""


@query("""SELECT c_custkey, CASE c_custkey % 8 WHEN 0 THEN 'not-an-object' WHEN 1 THEN 'missing-schema' WHEN 2 THEN 'unknown-schema' WHEN 3 THEN 'schema-kind-mismatch'
  WHEN 4 THEN 'malformed-schema-version' WHEN 5 THEN 'incompatible-schema-major' WHEN 6 THEN 'schema-minor-too-new' END AS defect FROM customer""")
def envelope_defects(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.sql(_ENVELOPES.replace("FROM customer", f"FROM parquet.`{d}/customer.parquet`"))
    return rows.select("c_custkey", exchange.envelope_error(F.col("document"), "corpus", ["corpus", "manifest"], 1, 1).alias("defect"))


@query("""SELECT c_custkey, o AS occurrence_id, c_custkey % 6 NOT IN (3, 4) AS context_preserved, CASE c_custkey % 6 WHEN 0 THEN 'removed' WHEN 3 THEN 'collateral-change'
  WHEN 2 THEN CASE o WHEN 0 THEN 'removed' ELSE 'residual-present' END WHEN 5 THEN CASE o WHEN 0 THEN 'residual-present' ELSE 'removed' END ELSE 'residual-present' END AS verdict
FROM customer, (VALUES (0), (1)) v(o)""")
def sanitized_outputs(spark: SparkSession, d: str) -> DataFrame:
    name, phone = F.col("c_name"), F.concat(F.lit("+1-"), F.lpad(F.col("c_custkey").cast("string"), 9, "0"))
    rows = spark.read.parquet(f"{d}/customer.parquet").select("c_custkey", "c_name")

    def said(a, b, end="; Ende", start="Kunde "):
        return F.concat(F.lit(start), a, F.lit(", Größe 12, Tel. "), b, F.lit(end))

    kind, mask = F.col("c_custkey") % 6, F.lit("[X]")
    sanitized = F.when(kind == 0, said(mask, F.lit(""))).when(kind == 1, said(name, phone)).when(kind == 2, said(mask, phone)).when(kind == 3, said(mask, mask, "; ENDE"))
    sanitized = sanitized.when(kind == 4, said(name, phone, start="An Kunde ")).otherwise(said(F.concat(F.lit("<"), name, F.lit(">")), mask))
    texts = rows.select("c_custkey", said(name, phone).alias("text"), sanitized.alias("sanitized"))
    n, gap = F.octet_length(name), F.octet_length(F.lit("Kunde , Größe 12, Tel. "))
    spans = F.array(F.struct(F.lit(0).alias("o"), F.lit(6).alias("s"), (n + 6).alias("e")), F.struct(F.lit(1).alias("o"), (n + gap).alias("s"), (n + gap + F.octet_length(phone)).alias("e")))
    held = rows.select("c_custkey", F.explode(spans).alias("x")).select("c_custkey", F.col("x.o").alias("occurrence_id"), F.col("x.s").alias("start"), F.col("x.e").alias("end"))
    return outputs.verify_outputs(held, texts, "c_custkey").drop("refusal")


_FIXTURES = """SELECT case_id, variant_id, occurrence_id, exp_start AS start, type_expectation AS identity, CASE WHEN variant_id % 9 = 0 THEN 'context-dependent' WHEN sensitivity = 'not-established' THEN 'sensitive'
  ELSE sensitivity END AS sensitivity, variant_id % 4 = 0 AS in_context, variant_id % 5 = 0 AS phi FROM expectations"""
_LOSSES = """SELECT loss, count(*) AS n FROM (SELECT unnest([CASE WHEN weak AND identity <> 'not-established' THEN 'identity-weakened-no-span' END,
  CASE WHEN weak AND sensitivity <> 'context-dependent' THEN 'sensitivity-weakened-no-span' END{more}]) AS loss FROM fixtures) WHERE loss IS NOT NULL GROUP BY loss"""
_PLAIN = """, CASE WHEN sensitivity = 'context-dependent' AND start IS NOT NULL THEN 'sensitivity-context-flattened' END, CASE WHEN in_context THEN 'contexts-not-carried' END, CASE WHEN phi THEN 'phi-domain-not-carried' END"""
_WEAK = {
    False: f"SELECT *, start IS NULL AS weak FROM ({_FIXTURES})",
    True: f"SELECT *, start IS NULL AND (identity = 'valid' OR sensitivity = 'sensitive' OR (identity <> 'invalid' AND sensitivity <> 'non-sensitive')) AS weak FROM ({_FIXTURES})",
}


def _fixtures(spark: SparkSession, d: str) -> DataFrame:
    rows = Of(spark, d).expectations.withColumn("start", F.col("exp_start")).withColumn("identity", F.col("type_expectation"))
    told = F.when(F.col("variant_id") % 9 == 0, "context-dependent").when(F.col("sensitivity") == "not-established", "sensitive").otherwise(F.col("sensitivity"))
    rows = rows.select("case_id", "variant_id", "occurrence_id", "start", "identity", told.alias("sensitivity"))
    domains = F.when(F.col("variant_id") % 5 == 0, F.array(F.lit("phi"), F.lit("pii"))).otherwise(F.array(F.lit("pii")))
    return rows.withColumn("contexts", F.when(F.col("variant_id") % 4 == 0, F.array(F.lit("form")))).withColumn("domains", domains)


@query(sql.ask("SELECT method, located, count(*) AS cases, CAST(sum(n) AS BIGINT) AS variants FROM (SELECT case_id, located, count(*) AS n, CASE WHEN NOT located THEN 'schema-only' WHEN bool_and(sensitivity = 'non-sensitive') THEN 'pii-benign' ELSE 'type-validation' END AS method FROM (SELECT *, start IS NOT NULL AS located FROM fixtures) GROUP BY case_id, located) GROUP BY ALL", (("fixtures", _FIXTURES),)))
def evidence_case_methods(spark: SparkSession, d: str) -> DataFrame:
    return evidence.case_methods(_fixtures(spark, d)).groupBy("method", "located").agg(F.count("*").alias("cases"), F.sum("variants").alias("variants"))


@query(sql.ask(_LOSSES.format(more=_PLAIN), (("fixtures", _WEAK[False]),)))
def evidence_losses(spark: SparkSession, d: str) -> DataFrame:
    return evidence.loss_counts(evidence.mapped(_fixtures(spark, d)))


@query(sql.ask(_LOSSES.format(more=""), (("fixtures", _WEAK[True]),)))
def evidence_losses_with_semantics(spark: SparkSession, d: str) -> DataFrame:
    return evidence.loss_counts(evidence.mapped(_fixtures(spark, d), semantics=True))


@query()
def legacy_rates(spark: SparkSession, d: str) -> DataFrame:
    """Without SQL: decimal rounding of a binary float's exact value is held against rational numbers in the tests."""
    rows = legacy_metric_counts(spark, d)
    point, bound = stats.legacy_rate(F.col("any_pass"), F.col("cases"), F.lit(False))
    return rows.select("scanner_id", "method", "cases", point.alias("point"), bound.alias("bound"))



def flagship(spark: SparkSession, d: str) -> DataFrame:
    return metric_published(spark, d).where("stratum = 'overall'")
