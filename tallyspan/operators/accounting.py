"""Accounting: outcomes folded to one standing per metric for each (scanner, case), then to ten metrics per stratum.

An outcome's standing in a metric is how much it says against a plain reading of the case: CLEAR, an EVENT, a measurement that is missing, or one
that waits for review; null where the metric does not look at the outcome. A case stands where its worst outcome stands, so the fold is ``max``,
which combines on the map side and doesn't depend on order. Strata are GROUPING SETS applied after the fold, when rows are already one per case.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import stats

CLEAR, EVENT, MISSING, REVIEW = range(4)
#: Metrics in order of their names, whether the bound is an upper one, and whether N is the eligible count.
METRICS = {
    "benign-suppression-rate": (False, False),
    "context-discrimination-rate": (False, False),
    "jurisdiction-collision-rate": (False, False),
    "measurable-share": (False, True),
    "non-sensitive-flag-rate": (True, False),
    "range-collateral-rate": (True, False),
    "sensitive-miss-rate": (True, False),
    "type-miss-rate": (True, False),
    "wrong-family-rate": (True, False),
    "wrong-jurisdiction-rate": (True, False),
}
STRATA = ("language", "jurisdiction", "method")


#: Columns of standings, and the metric that each decides. The last two both decide one.
STANDINGS = {
    "missed_type": "type-miss-rate",
    "wrong_family": "wrong-family-rate",
    "wrong_place": "wrong-jurisdiction-rate",
    "missed_sensitive": "sensitive-miss-rate",
    "flagged_harmless": "non-sensitive-flag-rate",
    "ends_told_apart": "context-discrimination-rate",
    "benign_left_alone": "benign-suppression-rate",
    "collision_resolved": "jurisdiction-collision-rate",
    "range_off": "range-collateral-rate",
    "type_measurable": "measurable-share",
    "sensitivity_measurable": "measurable-share",
}
#: Standings that count events; the others count cases without one.
COUNTS_EVENTS = ("missed_type", "wrong_family", "wrong_place", "missed_sensitive", "flagged_harmless", "range_off")


def standings() -> dict[str, Column]:
    """Each outcome's standing in each metric."""
    kind, mood, span = F.col("type_state"), F.col("sensitivity_state"), F.col("range_state")
    valid, method = F.col("type_expectation") == "valid", F.col("method")

    def gaps(state: Column, otherwise: Column) -> Column:
        return F.when(state == "unresolved", REVIEW).when(state == "not-measured", MISSING).otherwise(otherwise)

    def event(test: Column) -> Column:
        return F.when(test, EVENT).otherwise(CLEAR)

    def typed(test: Column) -> Column:
        return F.when(kind == "not-measured", MISSING).otherwise(event(test))

    wrong_mood, wrong_kind = event(mood != "correct"), event(~kind.isin("correct", "invalid-correct"))
    return {
        "missed_type": F.when(valid, typed(kind == "miss")),
        "wrong_family": F.when(valid, typed(kind == "wrong-family")),
        "wrong_place": F.when(valid & F.col("jurisdiction").isNotNull(), typed(kind == "wrong-jurisdiction")),
        "missed_sensitive": F.when(F.col("sensitivity") == "sensitive", gaps(mood, event(mood == "miss"))),
        "flagged_harmless": F.when(F.col("sensitivity") == "non-sensitive", gaps(mood, event(mood == "false-positive"))),
        "ends_told_apart": F.when(method == "context-discrimination", F.when(F.col("context_class") == "neutral", CLEAR).otherwise(gaps(mood, wrong_mood))),
        "benign_left_alone": F.when(method == "pii-benign", gaps(mood, wrong_mood)),
        "collision_resolved": F.when(method == "jurisdiction-collision", gaps(kind, wrong_kind)),
        "range_off": F.when(valid & (span != "miss"), F.when(span.isin("not-applicable", "unresolved"), MISSING).otherwise(event(span.isin("overbroad", "partial")))),
        "type_measurable": gaps(kind, F.lit(CLEAR)),
        "sensitivity_measurable": F.when(F.col("sensitivity") == "not-established", REVIEW).otherwise(gaps(mood, F.lit(CLEAR))),
    }


def case_standings(outcomes: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """(scanner_id, case_id, method, language, jurisdiction) and the worst standing in each metric. ``keep`` names further columns that a case decides."""
    worst = [F.max(c.cast("byte")).alias(name) for name, c in standings().items()]
    return outcomes.groupBy("scanner_id", "case_id", *sorted(STRATA), *keep).agg(*worst)


def alike(cases: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """The number n of cases of each scanner that agree in strata, ``keep`` and every standing: few rows however many cases, so what follows doesn't grow with them."""
    return cases.groupBy("scanner_id", *STRATA, *keep, *STANDINGS).agg(F.count("*").alias("n"))


def buckets(cases: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Each case's bucket in every metric: numerator, other, unresolved, not-measured or not-applicable; with n where the cases are those of ``alike``.

    A case of another method is not in the context metric at all. ``keep`` names further columns of ``cases``.
    """
    keep = (*[c for c in ("case_id", "n") if c in cases.columns], *keep)

    def bucket(name: str) -> Column:
        c = F.col(name)
        hit = EVENT if name in COUNTS_EVENTS else CLEAR
        found = F.when(c == REVIEW, "unresolved").when(c == MISSING, "not-measured").when(c == hit, "numerator").when(c.isNotNull(), "other")
        return found if name == "ends_told_apart" else F.coalesce(found, F.lit("not-applicable"))

    items = [F.struct(F.lit(metric).alias("metric"), bucket(name).alias("bucket")) for name, metric in STANDINGS.items()]
    rows = cases.select("scanner_id", *STRATA, *keep, F.explode(F.array(*items)).alias("i"))
    return rows.select("scanner_id", *STRATA, *keep, "i.metric", "i.bucket").where("bucket is not null")


def number(rows: DataFrame) -> Column:
    """How many cases the rows of a group are, be they one each or counted by ``alike``."""
    return F.sum("n") if "n" in rows.columns else F.count("*")


def tallies(bucketed: DataFrame, keys: tuple[str, ...] = ("scanner_id", "metric"), strata: tuple[str, ...] = STRATA) -> DataFrame:
    """Counts for each of ``keys`` and stratum: overall, and by each of ``strata``, which are language, jurisdiction and method."""
    once = bucketed.groupBy(*keys, *strata, "bucket").agg(number(bucketed).alias("n"))
    total = lambda name, *of: F.sum(F.when(F.col("bucket").isin(*of), F.col("n")).otherwise(0)).alias(name)
    sets = [list(map(F.col, of)) for of in (keys, *((*keys, s) for s in strata))]
    out = once.groupingSets(sets, *keys, *strata).agg(
        total("eligible", "numerator", "other", "unresolved", "not-measured"),
        total("measured", "numerator", "other"),
        total("numerator", "numerator"),
        total("unresolved", "unresolved"),
        total("not_measured", "not-measured"),
        total("not_applicable", "not-applicable"),
        F.sum("n").alias("total"),
        *[F.grouping(s).alias("without_" + s) for s in strata],
    )
    kind = F.lit("overall")
    for s in strata:
        kind = F.when(F.col("without_" + s) == 0, s).otherwise(kind)
    return out.withColumn("stratum", kind).withColumn("value", F.coalesce(*strata)).drop(*strata, *["without_" + s for s in strata])


def published(counts: DataFrame) -> DataFrame:
    """counts with effective N, status, and the exact point and bound where there is enough evidence."""
    upper = F.col("metric").isin([m for m, (up, _) in METRICS.items() if up])
    wide = F.col("metric").isin([m for m, (_, e) in METRICS.items() if e])
    out = counts.withColumn("n", F.when(wide, F.col("eligible")).otherwise(F.col("measured")))
    status = F.when(F.col("eligible") == 0, "not-applicable").when(F.col("measured") == 0, "not-measured").when(F.col("measured") < F.col("eligible"), "partial").otherwise("measured")
    enough = stats.value_state(F.col("n")) == "published"
    out = out.withColumn("status", status).withColumn("value_state", stats.value_state(F.col("n")))
    return out.withColumn("point", F.when(enough, stats.point_mantissa(F.col("numerator"), F.greatest("n", F.lit(1))))).withColumn("bound", F.when(enough, stats.wilson_mantissa(F.col("numerator"), F.col("n"), upper)))
