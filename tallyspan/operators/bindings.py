"""Whether the documents of one measurement belong together: inputs, scanners, scope, pairs to compare, plans, pins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The most violations that one report names.
MOST_VIOLATIONS = 64
#: Columns of an outcome that may be published.
PUBLIC = ["scanner_id", "case_id", "variant_id", "occurrence_id", "method", "type_state", "sensitivity_state", "range_state", "action_state", "action"]


def input_defects(scanners: DataFrame, inputs: DataFrame, variants: DataFrame) -> DataFrame:
    """(scanner_id, variant_id, code) of inputs (scanner_id, variant_id, input_digest) against variants (variant_id, text_digest).

    unknown-variant, input-digest-mismatch, and for a complete scanner that has not seen every variant observation-incomplete, without
    a variant. scanners: (scanner_id, status).
    """
    known = variants.select("variant_id", "text_digest", F.lit(True).alias("known"))
    rows = inputs.join(known, "variant_id", "left")
    code = F.when(F.col("known").isNull(), "unknown-variant").when(~F.col("input_digest").eqNullSafe(F.col("text_digest")), "input-digest-mismatch")
    single = rows.select("scanner_id", "variant_id", code.alias("code")).where("code is not null")
    seen = rows.where("known").select("scanner_id", "variant_id").distinct().groupBy("scanner_id").agg(F.count("*").alias("seen"))
    every = variants.agg(F.countDistinct("variant_id")).scalar()
    short = scanners.where("status = 'complete'").join(seen, "scanner_id", "left").where(F.coalesce(F.col("seen"), F.lit(0)) < every)
    return single.union(short.select("scanner_id", F.lit(None).cast("long"), F.lit("observation-incomplete")))


def scanner_defects(found: DataFrame, planned: DataFrame, fields: list[str]) -> DataFrame:
    """(scanner_id, code): scanners that no plan names, and those whose fields differ from the plan's or that are missing."""
    side = lambda df, name: df.select("scanner_id", F.struct(*fields).alias(name))
    rows = side(found, "has").join(side(planned, "wants"), "scanner_id", "full")
    code = F.when(F.col("wants").isNull(), "unknown-scanner").when(~F.col("has").eqNullSafe(F.col("wants")), "configuration-binding-mismatch")
    return rows.select("scanner_id", code.alias("code")).where("code is not null")


def field_defects(found: DataFrame, wanted: DataFrame, codes: dict[str, str]) -> DataFrame:
    """(path, code) of the columns in which two one-row tables differ, with the code of each column. Nulls agree."""
    pair = found.select(F.struct(*codes).alias("a"), F.lit(1).alias("one")).join(wanted.select(F.struct(*codes).alias("b"), F.lit(1).alias("one")), "one")
    marks = [F.when(~F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")), F.struct(F.lit(c).alias("path"), F.lit(code).alias("code"))) for c, code in codes.items()]
    return pair.select(F.explode(F.array_compact(F.array(*marks))).alias("x")).select("x.*")


def scope_defects(cases: DataFrame, languages: list[str], jurisdictions: list[str], methods: list[str]) -> DataFrame:
    """(path, code): parts of a plan's scope that some case lies outside of, found in one pass. Cases without a jurisdiction have none to miss."""
    outside = lambda c, known: F.coalesce(F.bool_or(~F.col(c).isin(known)), F.lit(False))
    some = cases.agg(outside("language", languages).alias("languages"), outside("jurisdiction", jurisdictions).alias("jurisdictions"), outside("method", methods).alias("methods"))
    codes = {"languages": "scope-violation", "jurisdictions": "scope-violation", "methods": "protocol-binding-mismatch"}
    marks = [F.when(F.col(c), F.struct(F.lit(c).alias("path"), F.lit(code).alias("code"))) for c, code in codes.items()]
    return some.select(F.explode(F.array_compact(F.array(*marks))).alias("x")).select("x.*")


def pairing(base: DataFrame, other: DataFrame) -> DataFrame:
    """(base_id, other_id, pairing) of two measurements' scanners (scanner_id, few by contract): by id, else the only one of each, else common ids."""
    side = lambda df, name: df.select("scanner_id", F.lit(True).alias(name))
    both = side(base, "in_base").join(side(other, "in_other"), "scanner_id", "full")
    a, b = (F.coalesce(F.col(c), F.lit(False)) for c in ("in_base", "in_other"))
    told = both.agg(
        F.when(F.count_if(~(a & b)) == 0, "by-id").when((F.count_if(a) == 1) & (F.count_if(b) == 1), "single-scanner").otherwise("by-id-intersection").alias("pairing"),
        F.min(F.when(a, F.col("scanner_id"))).alias("base_id"),
        F.min(F.when(b, F.col("scanner_id"))).alias("other_id"),
    )
    common = both.where(a & b).select(F.col("scanner_id").alias("base_id"), F.col("scanner_id").alias("other_id"))
    only = told.where("pairing = 'single-scanner'").select("base_id", "other_id", "pairing")
    return common.withColumn("pairing", told.select("pairing").scalar()).unionByName(only)


def refusals(base: DataFrame, other: DataFrame, pairs: DataFrame) -> DataFrame:
    """(refusal) of a comparison of two one-row tables (kind, legacy, protocol, run_class, population, mechanics) and their scanners' pairs."""
    same = {"kind": "artifact-kinds-differ", "protocol": "protocol-differs", "run_class": "run-class-differs", "population": "population-differs", "mechanics": "mechanics-differs"}
    differs = field_defects(base, other, same).select(F.col("code").alias("refusal"))
    older = base.select("legacy").union(other.select("legacy")).where("legacy").select(F.lit("legacy-protocol-revision").alias("refusal")).distinct()
    none = pairs.agg(F.count("*").alias("n")).where("n = 0").select(F.lit("scanner-sets-not-pairable").alias("refusal"))
    return differs.union(older).union(none)


def plan(cases: DataFrame) -> DataFrame:
    """One row: the methods, languages and jurisdictions of all cases, and the selectors that a scanner is activated for.

    Arrays are sorted; each has as many items as the vocabulary of its column, which doesn't grow with the cases.
    """
    named = lambda c: F.array_sort(F.collect_set(c)).alias(c + "s")
    rows = cases.agg(named("method"), named("language"), named("jurisdiction"))
    places = F.transform("jurisdictions", lambda j: F.concat(F.lit("pii:"), F.lower(j)))
    return rows.withColumn("selectors", F.array_sort(F.array_union(F.array(F.lit("pii:global")), places)))


def accepted(pins: DataFrame, artifacts: DataFrame) -> DataFrame:
    """(label, population, status, name) of each pin: the first artifact by name, of those without a reason against them, or none.

    pins: (label, population); artifacts: (name, population, reason).
    """
    best = artifacts.where("reason is null").groupBy("population").agg(F.min("name").alias("name"))
    status = F.when(F.col("name").isNull(), "missing").otherwise("accepted")
    return pins.join(best, "population", "left").select("label", "population", status.alias("status"), "name")


def first_violations(rows: DataFrame, most: int = MOST_VIOLATIONS) -> DataFrame:
    """The first violations in order of path and code, and whether there are more: (path, code, truncated)."""
    more = rows.limit(most + 1).agg(F.count("*") > most).scalar()
    return rows.orderBy("path", "code").limit(most).select("path", "code", more.alias("truncated"))


def published_rows(outcomes: DataFrame, run_class: Column) -> DataFrame:
    """Outcomes without what the scanner reported in detail. Rows of a protected run end the job."""
    allowed = F.assert_true(run_class != "protected", F.lit("rows of a protected run are not published"))
    return outcomes.where(allowed.isNull()).select(*PUBLIC)
