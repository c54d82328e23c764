"""The older accounting of cases, with three switches, and the switches that explain older figures.

A case's rows are judged together: under review before unmeasured before the metric's event. The switches are bits of a number:
FIRST_ROW lets a case's first row (by variant and occurrence) say whether a metric of valid types looks at the case, and then judges all its
rows, instead of its valid rows only; DISTINCT_BENIGN refuses a scanner with several rows for one benign case; ANY_ROW is content with one
row that passes, instead of all, in the metrics of benign and colliding cases.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FIRST_ROW, DISTINCT_BENIGN, ANY_ROW = 1, 2, 4
EVERY_SETTING = range(8)
COUNTS = ["eligible", "measured", "numerator", "unresolved", "not_measured", "not_applicable", "total"]
KEYS = ["scanner_id", "case_id"]


def _judged(looked: Column, state: str, event: Column) -> Column:
    """What a case's looked-at rows show together."""
    on = F.col(state)
    passed = ~looked | event
    some = lambda c: F.bool_or(looked & c)
    return F.struct(
        F.bool_or(looked).alias("looked"), some(on == "unresolved").alias("review"), some(on == "not-measured").alias("missing"), some(event).alias("some"), F.bool_and(passed).alias("every")
    )


def _bucket(name: str, quantifier: str = "some", given: Column | None = None) -> Column:
    s = F.col(name)
    looked = s["looked"] if given is None else s["looked"] & given
    out = F.when(~looked, "not-applicable").when(s["review"], "unresolved").when(s["missing"], "not-measured")
    return out.when(s[quantifier], "numerator").otherwise("other")


def counts(rows: DataFrame) -> DataFrame:
    """(scanner_id, switches, metric, COUNTS, refused) for every setting of the switches.

    rows: KEYS, variant_id, occurrence_id, method, context_class, jurisdiction, type_expectation, sensitivity, type_state, sensitivity_state,
    range_state. A metric without a case to count has zeros. Each row is read once: cases are folded to what every setting needs, then counted by the one switch that a metric heeds.
    """
    every, valid = F.lit(True), F.col("type_expectation") == "valid"
    kind, mood = F.col("type_state"), F.col("sensitivity_state")
    ends = (F.col("method") == "context-discrimination") & (F.col("context_class") != "neutral")
    events = {"type-miss-rate": kind == "miss", "wrong-family-rate": kind == "wrong-family", "wrong-jurisdiction-rate": kind == "wrong-jurisdiction"}
    folds = {f"{m}/{view}": _judged(looked, "type_state", e) for m, e in events.items() for view, looked in (("all", every), ("valid", valid))}
    for view, looked in (("all", every), ("valid", valid)):
        on = lambda *states: looked & F.col("range_state").isin(*states)
        missed = F.bool_and(~looked | (F.col("range_state") == "miss"))
        folds[f"range/{view}"] = F.struct(F.bool_or(looked).alias("looked"), missed.alias("missed"), F.bool_or(on("not-applicable")).alias("missing"), F.bool_or(on("overbroad", "partial")).alias("off"))
    folds["sensitive"] = _judged(F.col("sensitivity") == "sensitive", "sensitivity_state", mood == "miss")
    folds["harmless"] = _judged(F.col("sensitivity") == "non-sensitive", "sensitivity_state", mood == "false-positive")
    folds["ends"] = _judged(ends, "sensitivity_state", mood == "correct")
    folds["mood"] = _judged(every, "sensitivity_state", mood == "correct")
    folds["type"] = _judged(every, "type_state", kind.isin("correct", "invalid-correct"))
    first = F.min_by(valid, F.struct("variant_id", "occurrence_id")).alias("first_valid")
    placed = F.min_by(F.col("jurisdiction").isNotNull(), F.struct("variant_id", "occurrence_id")).alias("placed")
    open_mood = F.bool_or(F.col("sensitivity") == "not-established").alias("open_mood")
    cases = rows.groupBy(*KEYS).agg(F.min("method").alias("method"), F.count("*").alias("n"), first, placed, open_mood, *[c.alias(n) for n, c in folds.items()])

    def extent_of(view: str, given: Column) -> Column:
        s = F.col(f"range/{view}")
        out = F.when(~(s["looked"] & given) | s["missed"], "not-applicable").when(s["missing"], "not-measured")
        return out.when(s["off"], "numerator").otherwise("other")

    heard = F.col("first_valid")
    told: list[tuple[str, int, bool, Column]] = []
    for metric in events:
        given = F.col("placed") if metric == "wrong-jurisdiction-rate" else every
        told += [(metric, FIRST_ROW, False, _bucket(f"{metric}/valid", given=given)), (metric, FIRST_ROW, True, _bucket(f"{metric}/all", given=given & heard))]
    told += [("range-collateral-rate", FIRST_ROW, False, extent_of("valid", every)), ("range-collateral-rate", FIRST_ROW, True, extent_of("all", heard))]
    told += [("sensitive-miss-rate", 0, False, _bucket("sensitive")), ("non-sensitive-flag-rate", 0, False, _bucket("harmless"))]
    ended = F.when(F.col("ends.looked"), _bucket("ends", "every")).otherwise("numerator")
    told.append(("context-discrimination-rate", 0, False, F.when(F.col("method") == "context-discrimination", ended)))
    for metric, method, fold in (("benign-suppression-rate", "pii-benign", "mood"), ("jurisdiction-collision-rate", "jurisdiction-collision", "type")):
        told += [(metric, ANY_ROW, on, _bucket(fold, "some" if on else "every", F.col("method") == method)) for on in (False, True)]
    share = lambda s: F.when(s["review"], "unresolved").when(s["missing"], "not-measured").otherwise("numerator")
    told += [("measurable-share", 0, False, share(F.col("type"))), ("measurable-share", 0, False, F.when(F.col("open_mood"), "unresolved").otherwise(share(F.col("mood"))))]

    # cases that stand alike everywhere are counted before they are dealt into metrics, so that no row is repeated for each of them
    several = (F.col("method") == "pii-benign") & (F.col("n") > 1)
    stands = [f"stand{i}" for i in range(len(told))]
    alike = cases.select("scanner_id", several.alias("several"), *[t[-1].alias(c) for c, t in zip(stands, told)]).groupBy("scanner_id", "several", *stands).agg(F.count("*").alias("cases"))
    one = lambda m, bit, on, b: F.struct(F.lit(m).alias("metric"), F.lit(bit).alias("bit"), F.lit(on).alias("on"), F.col(b).alias("bucket"))
    stood = alike.select("scanner_id", "cases", F.explode(F.array(*[one(*t[:-1], c) for c, t in zip(stands, told)])).alias("x")).select("scanner_id", "cases", "x.*")
    n = lambda *names: F.sum(F.when(F.col("bucket").isin(*names), F.col("cases")).otherwise(0))
    tallied = stood.groupBy("scanner_id", "metric", "bit", "on").agg(
        n("numerator", "other", "unresolved", "not-measured").alias("eligible"), n("numerator", "other").alias("measured"), n("numerator").alias("numerator"),
        n("unresolved").alias("unresolved"), n("not-measured").alias("not_measured"), n("not-applicable").alias("not_applicable"), F.sum(F.when(F.col("bucket").isNotNull(), F.col("cases")).otherwise(0)).alias("total"),
    )
    mixed = alike.groupBy("scanner_id").agg(F.coalesce(F.bool_or("several"), F.lit(False)).alias("mixed"))
    settings = tallied.withColumn("switches", F.explode(F.array(*map(F.lit, EVERY_SETTING))))
    settings = settings.where((F.col("bit") == 0) | ((F.col("switches").bitwiseAND(F.col("bit")) > 0) == F.col("on"))).join(mixed, "scanner_id")
    refused = F.col("mixed") & (F.col("switches").bitwiseAND(F.lit(DISTINCT_BENIGN)) > 0)
    return settings.select("scanner_id", "switches", "metric", *COUNTS, refused.alias("refused"))


def explained(found: DataFrame, previous: DataFrame) -> DataFrame:
    """(scanner_id, metric, switches): the fewest switches under which ``counts`` gives an older figure's counts; null where none do."""
    old = previous.select("scanner_id", "metric", F.struct(*COUNTS).alias("old"))
    rows = old.join(found.select("scanner_id", "metric", "switches", "refused", F.struct(*COUNTS).alias("new")), ["scanner_id", "metric"], "left")
    fits = F.when((F.col("old") == F.col("new")) & ~F.col("refused"), F.col("switches"))
    return rows.groupBy("scanner_id", "metric").agg(F.min_by(fits, F.when(fits.isNotNull(), F.struct(F.bit_count(fits), fits))).alias("switches"))
