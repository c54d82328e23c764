"""Projections: the population dealt into cells of a view and a family, their strata, and the checks of a stored projection.

A roster gives each case its view and may give it a control class. Cells come from the same rows as the overall metrics: one row per
case and metric, counted once by all strata and then folded by grouping sets, so no stratum reads the outcomes again.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import accounting

CELL = ["scanner_id", "view", "family"]
COUNTED = ["cases", "variants", "occurrences"]
STRATA = ("language", "control_class")


def case_families(expectations: DataFrame) -> DataFrame:
    """(case_id, family): a case's collision target, else the one family of all its expectations; null where they differ or lack one."""
    same = (F.min("family") == F.max("family")) & (F.count("family") == F.count("*"))
    return expectations.groupBy("case_id").agg(F.coalesce(F.max("target"), F.when(same, F.min("family"))).alias("family"))


def cells(bucketed: DataFrame) -> DataFrame:
    """Counts of each metric for each (scanner_id, view, family), overall and by language and control class.

    bucketed: (scanner_id, view, family, language, control_class, metric, bucket). Cases without a class are in no class's stratum.
    """
    return accounting.tallies(bucketed, (*CELL, "metric"), STRATA).where("stratum = 'overall' or value is not null")


def authored(expectations: DataFrame, scanners: DataFrame) -> DataFrame:
    """What each scanner's cells must count: cases, variants and occurrences of (view, family), which no scanner changes."""
    counts = expectations.groupBy("view", "family").agg(F.countDistinct("case_id").alias("cases"), F.countDistinct("variant_id").alias("variants"), F.count("*").alias("occurrences"))
    return counts.crossJoin(F.broadcast(scanners.select("scanner_id"))).select(*CELL, *COUNTED)


def restricted(rows: DataFrame, roster: DataFrame, view: str) -> DataFrame:
    """The rows whose case the roster puts into ``view``."""
    return rows.join(roster.where(F.col("view") == view).select("case_id"), "case_id", "left_semi")


def roster_defects(cases: DataFrame, roster: DataFrame, classes: DataFrame, required: list[str]) -> DataFrame:
    """(subject, code): what keeps a roster from assigning every case once, to a required view.

    cases: (case_id, family), roster: (case_id, view), classes: (case_id, control_class). ``required`` are the plan's few views. All three
    are counted by the case in one aggregate of numbers, so no table is joined or sorted.
    """
    no = F.lit(0)

    def seen(rows: DataFrame, known: Column = no, dealt: Column = no, classed: Column = no, vague: Column = no) -> DataFrame:
        return rows.select("case_id", *[c.cast("long").alias(n) for n, c in (("known", known), ("dealt", dealt), ("classed", classed), ("vague", vague))])

    one = F.lit(1)
    rows = seen(cases, known=one, vague=F.col("family").isNull().cast("int")).union(seen(roster, dealt=one)).union(seen(classes, classed=one))
    sums = rows.groupBy("case_id").agg(*[F.sum(c).alias(c) for c in ("known", "dealt", "classed", "vague")])
    # an id that is null is no case's
    there, absent = F.col("known") > 0, (F.col("known") == 0) | F.col("case_id").isNull()
    times = {
        "unknown-case": F.when(absent, F.col("dealt")),
        "duplicate-assignment": F.when(F.col("dealt") > 1, 1),
        "unassigned-case": F.when(there & ((F.col("dealt") == 0) | F.col("case_id").isNull()), 1),
        "ambiguous-family": F.col("vague"),
        "unknown-control-case": F.when(absent, F.col("classed")),
        "duplicate-control-assignment": F.when(F.col("classed") > 1, 1),
    }
    named = F.flatten(F.array(*[F.array_repeat(F.lit(code), F.coalesce(n, no).cast("int")) for code, n in times.items()]))
    some = absent | (F.col("dealt") != 1) | (F.col("classed") > 1) | (F.col("vague") > 0)
    of_cases = sums.where(some).select(F.col("case_id").cast("string").alias("subject"), F.explode(named).alias("code"))

    views = cases.sparkSession.createDataFrame([(v,) for v in sorted(set(required))], "view string")
    other = roster.where(~F.coalesce(F.col("view").isin(required), F.lit(False))).select(F.col("case_id").cast("string").alias("subject"), F.lit("view-not-required").alias("code"))
    empty = views.join(roster.select("view").distinct(), "view", "left_anti").select(F.col("view").alias("subject"), F.lit("empty-required-view").alias("code"))
    return of_cases.union(other).union(empty)


def _code(stored: list[Column], wanted: list[Column]) -> Column:
    """Counts beyond those of the population come from a pooled denominator; other differences are a mismatch."""
    any_of = lambda tests: reduce(lambda a, b: a | b, tests)
    more, other = (any_of([test(s, w) for s, w in zip(stored, wanted)]) for test in (lambda s, w: s > w, lambda s, w: ~s.eqNullSafe(w)))
    return F.when(more, "projection-pooled-denominator").when(other, "count-mismatch")


def compare_cells(stored: DataFrame, wanted: DataFrame) -> DataFrame:
    """(scanner_id, view, family, code): cells whose stored counts differ from the recomputed ones, or that one side lacks."""
    a = stored.select(*CELL, *[F.col(c).alias("a_" + c) for c in COUNTED])
    b = wanted.select(*CELL, *[F.col(c).alias("b_" + c) for c in COUNTED])
    code = _code([F.col("a_" + c) for c in COUNTED], [F.col("b_" + c) for c in COUNTED])
    return a.join(b, CELL, "full").select(*CELL, code.alias("code")).where("code is not null")


def sum_defects(stored: DataFrame, totals: DataFrame, scanners: DataFrame, required: list[str]) -> DataFrame:
    """(scanner_id, view, code): required views that a scanner has no cell of, and scanners whose cells don't add up to the population.

    totals is the one row of the population's cases, variants and occurrences; scanners are few by contract.
    """
    ids = scanners.select("scanner_id")
    every = ids.withColumn("view", F.explode(F.array(*map(F.lit, required))))
    absent = every.join(stored.select("scanner_id", "view").distinct(), ["scanner_id", "view"], "left_anti").withColumn("code", F.lit("projection-view-missing"))
    sums = ids.join(stored.groupBy("scanner_id").agg(*[F.sum(c).alias("a_" + c) for c in COUNTED]), "scanner_id", "left")
    sums = sums.crossJoin(F.broadcast(totals.select(*[F.col(c).alias("b_" + c) for c in COUNTED])))
    code = _code([F.coalesce("a_" + c, F.lit(0)) for c in COUNTED], [F.col("b_" + c) for c in COUNTED])
    return absent.union(sums.select("scanner_id", F.lit(None).cast("string").alias("view"), code.alias("code")).where("code is not null"))


def with_verdicts(outcomes: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Outcomes whose action gives way to the verdict on a sanitized output.

    That holds for located occurrences of a complete scanner that declares sanitized outputs (``cap_action``). verdicts: (scanner_id, variant_id,
    occurrence_id, verdict), one row for each key at most.
    """
    keys = ["scanner_id", "variant_id", "occurrence_id"]
    told = F.col("verdict").isNotNull() & (F.col("status") == "complete") & (F.col("cap_action") == "sanitized-output") & ~F.col("text_negative")
    rows = outcomes.join(verdicts.select(*keys, "verdict"), keys, "left").withColumn("told", F.coalesce(told, F.lit(False)))
    rows = rows.withColumn("action_state", F.when(F.col("told"), "output-verified").otherwise(F.col("action_state")))
    rows = rows.withColumn("action", F.when(~F.col("told"), F.col("action")))
    return rows.withColumn("verdict", F.when(F.col("told"), F.col("verdict"))).drop("told")
