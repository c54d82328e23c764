"""Checks that return the offending rows: missing, duplicated, out of the lattice, out of scope, changed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import capabilities, identity
from . import accounting

KEYS = ["scanner_id", "variant_id", "occurrence_id"]
#: Type states that an authored expectation can lead to.
REACHABLE = {
    "valid": ("correct", "miss", "wrong-family", "wrong-jurisdiction", "not-measured"),
    "invalid": ("invalid-correct", "invalid-accepted", "not-measured"),
    "not-established": ("unresolved", "not-measured"),
}


#: The same for sensitivity.
REACHABLE_MOODS = {
    "not-established": ("unresolved", "not-measured"),
    "context-dependent": ("unresolved", "not-measured"),
    "sensitive": ("correct", "miss", "not-measured"),
    "non-sensitive": ("correct", "false-positive", "not-measured"),
}


def is_unmeasured() -> Column:
    return (F.col("type_state") == "not-measured") & (F.col("sensitivity_state") == "not-measured") & (F.col("range_state") == "not-applicable") & (F.col("action_state") == "not-measured")


def missing(matrix: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Rows of the complete matrix without an outcome."""
    return matrix.join(outcomes.select(*KEYS), KEYS, "left_anti")


def duplicates(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def lattice(outcomes: DataFrame) -> DataFrame:
    """Outcomes that their expectation, or their scanner, cannot lead to, each with the first rule that it breaks as ``code``.

    Reads what ``matching.assess`` gives. A range is observed against a located occurrence only, and then it is never unresolved.
    """
    located, unmeasured, span = F.col("exp_start").isNotNull(), F.col("type_state") == "not-measured", F.col("range_state")
    reachable = lambda axis, authored, table: F.coalesce(*[F.when(F.col(authored) == e, F.col(axis).isin(*s)) for e, s in table.items()], F.lit(False))
    code = (
        F.when(F.when(located, span == "unresolved").otherwise(~span.isin("unresolved", "not-applicable")), "range-contradiction")
        .when(~reachable("type_state", "type_expectation", REACHABLE), "unreachable-type")
        .when(~reachable("sensitivity_state", "sensitivity", REACHABLE_MOODS), "unreachable-sensitivity")
        .when((F.col("status") != "complete") & ~is_unmeasured(), "measured-by-incomplete-scanner")
        .when(capabilities.rules_out_type(F.col("family_state"), F.col("place_state")) & ~unmeasured, "measured-unsupported-type")
        .when(capability_conflict(), "capability-contradiction")
    )
    return outcomes.withColumn("code", code).where("code is not null")


def outside(cases: DataFrame, languages: list[str], jurisdictions: list[str]) -> DataFrame:
    """Cases beyond the languages or jurisdictions of a plan; a case without a jurisdiction is global and in scope."""
    return cases.where(~F.col("language").isin(languages) | ~F.coalesce(F.col("jurisdiction").isin(jurisdictions), F.lit(True)))


def changed(stored: DataFrame, recomputed: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, stored, recomputed) where the two differ or one is absent."""
    a, b = stored.withColumnRenamed(value, "stored"), recomputed.withColumnRenamed(value, "recomputed")
    return a.join(b, keys, "full").where(~F.col("stored").eqNullSafe(F.col("recomputed")))


#: References of an evidence snapshot: (table, its column, one id or an array of ids; the table whose ids it names).
REFERENCES = [
    ("claims", "source", "sources"),
    ("cases", "kind", "kinds"),
    ("cases", "jurisdiction", "jurisdictions"),
    ("cases", "contexts", "contexts"),
    ("cases", "sources", "sources"),
    ("cases", "claims", "claims"),
    ("cases", "related", "cases"),
    ("cases", "events", "events"),
    ("rules", "cases", "cases"),
    ("skips", "case", "cases"),
    ("skips", "rule", "rules"),
]


def unresolved(tables: dict[str, DataFrame], references: list[tuple[str, str, str]] = REFERENCES) -> DataFrame:
    """(owner, id, field, target): references to an id that the table they name doesn't have; each table has a column id."""
    found = []
    for owner, field, to in references:
        rows = tables[owner]
        many = dict(rows.dtypes)[field].startswith("array")
        rows = rows.select("id", (F.explode(field) if many else F.col(field)).alias("target")).withColumn("target", F.col("target").cast("string"))
        ids = tables[to].select(F.col("id").cast("string").alias("target"))
        found.append(rows.join(ids, "target", "left_anti").select(F.lit(owner).alias("owner"), F.col("id").cast("string").alias("id"), F.lit(field).alias("field"), "target"))
    out = found[0]
    for rows in found[1:]:
        out = out.union(rows)
    return out


def capability_conflict() -> Column:
    """Whether an outcome says what its scanner's declared capabilities rule out.

    Reads cap_ranges, cap_family, cap_jurisdiction, cap_sensitivity (``unsupported`` or more) and cap_action, with the four states.
    """
    no = lambda c: F.col("cap_" + c) == "unsupported"
    action = F.col("action_state")
    return F.coalesce(
        (no("ranges") & (F.col("range_state") != "not-applicable"))
        | (no("family") & (F.col("type_state") != "not-measured"))
        | (no("jurisdiction") & (F.col("type_state") == "wrong-jurisdiction"))
        | (no("sensitivity") & (F.col("sensitivity_state") != "not-measured"))
        | (action.isin("no-action-reported", "reported") & (F.col("cap_action") == "unavailable"))
        | ((action == "output-verified") & (F.col("cap_action") != "sanitized-output")),
        F.lit(False),
    )


#: The most replays of a scanner.
MOST_REPLAYS = 1024


def observation_defects(scanners: DataFrame, findings: DataFrame) -> DataFrame:
    """(scanner_id, variant_id, code), each once: scanner states, orders and findings that no observation may have.

    scanners: (scanner_id, status, replays, agreed, cap_ranges, cap_family, cap_jurisdiction, cap_sensitivity), few by contract. A complete scanner agrees with
    its replays and has ranges, an unstable one disagrees, and one that isn't complete has no inputs. The findings of an
    input stand in ascending order by emission, nulls first; each is held against the one before it. Equal emissions stand in any order.
    """
    status, no = F.col("status"), lambda c: F.coalesce(F.col("cap_" + c) == "unsupported", F.lit(False))
    fits = F.col("replays").between(1, MOST_REPLAYS) & F.when(status == "complete", F.col("agreed") & ~no("ranges")).when(status == "unstable", ~F.col("agreed")).otherwise(True)
    held = findings.select("scanner_id", F.lit(True).alias("held")).distinct()
    states = scanners.join(held, "scanner_id", "left").where(~F.coalesce(fits, F.lit(False)) | (F.col("held") & (status != "complete")))
    states = states.select("scanner_id", F.lit(None).cast("long").alias("variant_id"), F.lit("status-inconsistent").alias("code"))

    key = F.struct("f_start", "f_end", "f_family", "f_jurisdiction", "f_sensitive", "f_action")
    rows = findings.withColumn("key", key).withColumn("before", F.lag("key").over(W.partitionBy("scanner_id", "variant_id").orderBy("emission", "key")))
    rows = rows.join(F.broadcast(scanners.select("scanner_id", *[no(c).alias("no_" + c) for c in ("family", "jurisdiction", "sensitivity")])), "scanner_id")
    said = (F.col("no_family") & F.col("f_family").isNotNull()) | (F.col("no_jurisdiction") & F.col("f_jurisdiction").isNotNull()) | (F.col("no_sensitivity") & F.col("f_sensitive").isNotNull())
    codes = F.array(
        F.when(F.col("before") > F.col("key"), "non-canonical-order"),
        F.when(F.coalesce((F.col("f_start") < 0) | (F.col("f_start") >= F.col("f_end")), F.lit(True)), "range-invalid"),
        F.when(said, "capability-contradiction"),
    )
    rows = rows.select("scanner_id", "variant_id", F.explode(F.array_compact(codes)).alias("code"))
    return states.union(rows.distinct())


def expectation_defects(expectations: DataFrame) -> DataFrame:
    """The expectations with a column ``code``, one row for each defect of an expectation.

    Reads exp_start, exp_end, text_negative, type_expectation, sensitivity, family (scoped, see ``identity``) and jurisdiction. What isn't located
    says nothing, unless it is about the whole text; then it must be negative and have no range.
    """
    kind, mood, start, end, whole = (F.col(c) for c in ("type_expectation", "sensitivity", "exp_start", "exp_end", "text_negative"))
    bad_whole = whole & (start.isNotNull() | (kind == "valid") | (mood == "sensitive") | ((kind != "invalid") & (mood != "non-sensitive")))
    bad_open = start.isNull() & ~whole & ((kind != "not-established") | ~mood.isin("not-established", "context-dependent"))
    codes = F.array(
        F.when(bad_whole | bad_open, "range-not-established-invalid"),
        F.when(start.isNotNull() & F.coalesce((start < 0) | (start >= end), F.lit(True)), "range-invalid"),
        F.when(~identity.scope_agrees(F.col("family"), F.col("jurisdiction")), "family-scope-mismatch"),
    )
    return expectations.withColumn("code", F.explode(F.array_compact(codes)))


def counts_consistent() -> Column:
    """Whether a metric's counts add up: eligible and not applicable to the total, measured, unresolved and not measured to eligible."""
    parts = [F.col(c) for c in ("eligible", "not_applicable", "total", "measured", "unresolved", "not_measured", "numerator")]
    safe = F.greatest(*parts) <= identity.MOST_SAFE
    whole = F.col("eligible") + F.col("not_applicable") == F.col("total")
    inner = F.col("measured") + F.col("unresolved") + F.col("not_measured") == F.col("eligible")
    return safe & whole & inner & (F.col("numerator") <= F.col("measured"))


#: The failures that each state of a scanner can name.
FAILURES = {
    "unsupported": ("unsupported",),
    "unavailable": ("unavailable",),
    "unstable": ("replay-disagreement",),
    "error": ("execution-error", "timeout", "output-limit-exceeded", "malformed-output", "cancelled", "resource-limit-exceeded"),
}


def failure_allowed(status: Column, failure: Column) -> Column:
    """Whether a scanner in this state can have failed so; a complete one has no failure."""
    out = F.lit(False)
    for state, codes in FAILURES.items():
        out = F.when(status == state, failure.isin(*codes)).otherwise(out)
    return F.coalesce(out, F.lit(False))


def first_failures(failures: DataFrame, at: str = "variant_id") -> DataFrame:
    """(scanner_id, at, code): each scanner's failure at its least input; of several there the least code."""
    least = failures.groupBy("scanner_id").agg(F.min(F.struct(at, "code")).alias("f"))
    return least.select("scanner_id", "f." + at, "f.code")


#: The ranges of a measurement's mechanics.
REPLAYS, PLACES = (2, 1024), (1, 12)


def mechanics_valid(least_n: Column, replays: Column, z: Column, z_scale: Column, places: Column) -> Column:
    """Whether a measurement's mechanics are within their ranges, z written without zeros at its end; null counts as not."""
    neat = identity.scaled_decimal(z, z_scale)["scale"] == z_scale
    return F.coalesce((least_n >= 1) & replays.between(*REPLAYS) & (z > 0) & neat & places.between(*PLACES), F.lit(False))


def custodian_cells(counts: DataFrame, labels: DataFrame, observed: int) -> DataFrame:
    """(scanner_id, metric, stratum, label, numerator, measured, code) of the metrics that a custodian's labels (metric, label) publish.

    The code names a label of the wrong shape, one that stands for several metrics, or counts beyond the roster; null for a sound cell.
    """
    rows = counts.join(labels, "metric")
    shared = labels.groupBy("label").agg((F.count("*") > 1).alias("shared"))
    code = F.when((F.col("numerator") > F.col("measured")) | (F.col("measured") > observed), "roster-violation")
    code = F.when(~F.col("label").rlike(identity.SHAPES["slug"]) | F.col("shared"), "label-invalid").otherwise(code)
    return rows.join(shared, "label").select("scanner_id", "metric", F.lit("overall").alias("stratum"), "label", "numerator", "measured", code.alias("code"))


RESULT = ["scanner_id", "metric", "stratum", "value"]
#: What a metric's result publishes besides its counts.
TOLD = ["n", "status", "value_state", "point", "bound"]


def metric_defects(results: DataFrame) -> DataFrame:
    """(RESULT, path, code) of results that contradict themselves: their counts, then their effective n, then the value that both give.

    results: RESULT, the seven counts and TOLD. Only the first of the three is named, as each rests on the one before.
    """
    counts = results.select(*[c for c in results.columns if c not in TOLD], F.struct(*TOLD).alias("given"))
    rows = accounting.published(counts)
    given = F.col("given")
    same = lambda *names: F.struct(*names).eqNullSafe(F.struct(*[given[c].alias(c) for c in names]))
    path = F.when(~F.coalesce(counts_consistent(), F.lit(False)) | ~same("status"), "counts").when(~same("n"), "effectiveN").when(~same("value_state", "point", "bound"), "value")
    code = F.when(path == "value", "metric-value-inconsistent").otherwise("metric-counts-inconsistent")
    return rows.select(*RESULT, path.alias("path"), code.alias("code")).where("path is not null")


def result_diff(stored: DataFrame, recomputed: DataFrame) -> DataFrame:
    """(RESULT, code) where stored results differ from those recomputed from rows: absent, unknown, count-mismatch, else metric-value-inconsistent."""
    numbers = [c for c in recomputed.columns if c not in (*RESULT, *TOLD)]
    side = lambda df, name: df.select(*[F.col(c).alias(f"{name}_{c}") for c in RESULT], F.struct(*sorted(numbers)).alias(f"{name}_counts"), F.struct(*TOLD).alias(f"{name}_told"))
    on = [F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}")) for c in RESULT]
    rows = side(stored, "a").join(side(recomputed, "b"), on, "full")
    code = F.when(F.col("a_counts").isNull(), "result-missing").when(F.col("b_counts").isNull(), "unknown-result").when(F.col("a_counts") != F.col("b_counts"), "count-mismatch")
    code = code.when(~F.col("a_told").eqNullSafe(F.col("b_told")), "metric-value-inconsistent")
    return rows.select(*[F.coalesce(f"a_{c}", f"b_{c}").alias(c) for c in RESULT], code.alias("code")).where("code is not null")
