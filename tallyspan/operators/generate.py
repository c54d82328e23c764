"""Generation of variants from authored cases: guards, context frames, collisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import identity, ranges
from . import batching

#: Frames of this engine's own sample plan.
FRAMES = [("frame-0", "Employee number: {{candidate}}.", "sensitive"), ("frame-1", "Größe {{candidate}} cm", "neutral"), ("frame-2", "sample {{candidate}}", "non-sensitive")]
#: The largest text, and the most families that compete with one.
MAX_TEXT_BYTES, MAX_COMPETING = 1024 * 1024, 32
FAMILIES = ["card", "email", "phone", "ssn"]


def frames(cases: DataFrame, plan: list[tuple[str, str, str]] = FRAMES) -> DataFrame:
    """Each case's value in every frame: (case_id, slot, context_class, text, start)."""
    plans = F.array(*[F.struct(F.lit(s).alias("slot"), F.lit(t).alias("template"), F.lit(c).alias("context_class")) for s, t, c in plan])
    rows = cases.withColumn("f", F.explode(plans))
    text, start = identity.framed(F.col("f.template"), F.col("value"))
    return rows.select("case_id", "f.slot", "f.context_class", text.alias("text"), start.alias("start")).where("text is not null")


def refusal(max_text_bytes: int = MAX_TEXT_BYTES) -> Column:
    """The first reason to refuse a case, or null, from the case's own columns.

    Every case: text, exp_start, exp_end, family (scoped, see ``identity``), jurisdiction, method and evidence_method, null without
    evidence. Then pii-benign reads sensitivity, benign_class, evidence_classes and checks; jurisdiction-collision competing, cross_family
    and checks. Checks are structs of validator, version and expected state, held against the candidate.
    """
    text, start, end = F.col("text"), F.col("exp_start"), F.col("exp_end")
    defect = ranges.range_error(text, start, end)
    value = F.when(defect.isNull(), F.decode(F.substring(F.encode(text, "UTF-8"), (start + 1).cast("int"), (end - start).cast("int")), "UTF-8"))
    see = lambda c: identity.observe(c["validator"], c["version"], value)
    failed = F.get(F.filter("checks", lambda c: see(c) != c["expected"]), F.lit(0))
    check = F.when(failed.isNotNull(), F.when(see(failed) == "unavailable", "validator-check-unavailable").otherwise("validator-check-mismatch"))
    evidence = F.col("evidence_method").isNotNull()
    rivals = F.array_distinct(F.array_compact(F.coalesce("competing", F.array().cast("array<string>"))))
    benign = F.when(~F.col("sensitivity").eqNullSafe("non-sensitive"), "not-non-sensitive").when(
        evidence & ~F.coalesce(F.array_contains("evidence_classes", F.col("benign_class")), F.lit(False)), "evidence-role-mismatch"
    )
    collision = (
        F.when((F.size(rivals) == 0) | F.array_contains(rivals, F.col("family")) | (F.size(rivals) > MAX_COMPETING), "invalid-collision")
        .when(F.col("cross_family") & (F.coalesce(F.size("checks"), F.lit(0)) < 1 + F.size(rivals)), "missing-evidence-checks")
    )
    return (
        F.when(F.octet_length(text) > max_text_bytes, "text-too-large")
        .when(text.isNull() | start.isNull() | end.isNull() | (start < 0) | defect.isin("inverted", "empty"), "range-invalid")
        .when(defect == "too-large", "range-offset-too-large")
        .when(defect == "out-of-bounds", "range-out-of-bounds")
        .when(defect == "not-a-boundary", "range-not-on-char-boundary")
        .when(~identity.scope_agrees(F.col("family"), F.col("jurisdiction")), "family-scope-mismatch")
        .when(evidence & (F.col("evidence_method") != F.col("method")), "evidence-role-mismatch")
        .when(F.col("method") == "jurisdiction-collision", F.coalesce(collision, check))
        .when(F.col("method") == "pii-benign", F.coalesce(benign, check))
    )


def guarded(cases: DataFrame, max_text_bytes: int = MAX_TEXT_BYTES) -> DataFrame:
    return cases.withColumn("reason", refusal(max_text_bytes))


def collisions(cases: DataFrame) -> DataFrame:
    """(case_id, target, competing): families that compete with the target, without it."""
    others = F.array_sort(F.array_remove(F.array(*map(F.lit, FAMILIES)), F.col("family")))
    return cases.select("case_id", F.col("family").alias("target"), F.array_join(others, ",").alias("competing"))


def held_against_validator(cases: DataFrame) -> DataFrame:
    """cases with observed, reason, strategy and review, for the methods type-validation and reference-differential.

    Reads method, value, type_expectation, validator and version. A validator must agree with what is expected, else the case is refused; a
    reference that disagrees is recorded and never replaces the expectation. What is unavailable leaves the variant to review.
    """
    state = identity.observe(F.col("validator"), F.col("version"), F.col("value"))
    named, reference = F.col("validator").isNotNull(), F.col("method") == "reference-differential"
    rows = cases.where(F.col("method").isin("type-validation", "reference-differential")).withColumn("observed", F.when(named, state))
    gone = F.coalesce(F.col("observed") == "unavailable", F.lit(False))
    differs = F.coalesce(F.col("type_expectation").isin("valid", "invalid") & ~gone & (F.col("observed") != F.col("type_expectation")), F.lit(False))
    reason = F.when(~named, F.when(reference, "missing-reference").otherwise("missing-validator")).when(differs & ~reference, "validator-expectation-mismatch")
    review = F.when(gone, F.when(reference, "reference-unavailable").otherwise("validator-unavailable")).when(differs & reference, "reference-disagrees")
    strategy = F.when(F.col("reason").isNull(), F.when(gone, "review-required").otherwise("authored"))
    return rows.withColumn("reason", reason).withColumn("review", review).withColumn("strategy", strategy)


#: Each method's version, slots, derivation, variants of a case (null: one for each frame given), what a validator does in it, the
#: metric that only it feeds, and whether its rows tell of a scanner's behaviour on real input.
METHODS = [
    ("type-validation", 2, "validated", "authored", 1, "confirms", None, True),
    ("context-discrimination", 2, "frame", "context-frames", 3, "none", "context-discrimination-rate", True),
    ("pii-benign", 3, "benign-class", "authored", 1, "checks-authored-expectations", "benign-suppression-rate", True),
    ("jurisdiction-collision", 3, "collision", "authored", 1, "checks-authored-expectations", "jurisdiction-collision-rate", True),
    ("mutation", 1, "mutated", "operator", 1, "none", None, True),
    ("reference-differential", 1, "reference", "authored", 1, "observed-not-truth", None, True),
    ("schema-only", 1, "authored", "authored", 1, "none", None, False),
]
#: The most variants and refusals of one batch.
BATCH_UNITS = 1024


def methods(spark: SparkSession) -> DataFrame:
    """The seven methods, one row each."""
    return spark.createDataFrame(METHODS, "method string, version int, slots string, derivation string, variants int, validator string, only_metric string, runtime_evidence boolean")


def run_defects(results: DataFrame, most_cases: int, most_of_method: int, most_variants: int) -> DataFrame:
    """(subject, code): limits of a run that its results (case_id, method, variants; 0 for a refusal) exceed, and cases that stand twice."""
    by_method = results.groupBy("method").agg(F.count("*").alias("cases"), F.sum("variants").alias("variants"))
    whole = by_method.agg(F.sum("cases").alias("cases"), F.sum("variants").alias("variants"))
    over = [F.when(F.col("cases") > most_cases, "limit-cases"), F.when(F.col("variants") > most_variants, "limit-total-variants")]
    out = whole.select(F.lit("run").alias("subject"), F.explode(F.array_compact(F.array(*over))).alias("code"))
    out = out.union(by_method.where(F.col("variants") > most_of_method).select("method", F.lit("limit-variants-per-method")))
    return out.union(results.groupBy("case_id").count().where("count > 1").select(F.col("case_id").cast("string"), F.lit("duplicate-case")))


def batches(results: DataFrame, most_units: int = BATCH_UNITS) -> DataFrame:
    """(case_id, units, batch): the run's cases in order of id, packed into batches of at most ``most_units`` (see ``batching``).

    A case weighs its variants, a refusal one; a case heavier than a batch stands alone.
    """
    units = F.when(F.col("variants") > 0, F.col("variants")).otherwise(1)
    return batching.packed(results, "case_id", units, most_units)
