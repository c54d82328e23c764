"""Why an older reading of a finding differs from the present one: the fewest switches that lead from one to the other.

The older rule takes the first finding that overlaps; the present one takes the closest. Each switch turns one part of the older rule into the
present one, ORDER first: which finding is read. Every row is read under all settings at once, and the setting of the fewest switches that gives
the present row explains it; so there is no pass for each setting, and a row that none explains shows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import capabilities, ranges
from . import matching

#: ORDER reads the closest finding instead of the first; UNREPORTED doesn't measure what the finding leaves out; CAPABILITY doesn't measure what the
#: scanner can't tell; PLACE lets a wrong jurisdiction go before a wrong family.
ORDER, UNREPORTED, CAPABILITY, PLACE = 1, 2, 4, 8
SETTINGS = range(16)


def _reading(s: int) -> Column:
    """The type, sensitivity and range of an occurrence under a setting."""
    f, place = F.col("closest" if s & ORDER else "first"), F.col("jurisdiction")
    seen, family, juris, flag = f.isNotNull(), f["f_family"], f["f_jurisdiction"], f["f_sensitive"]
    elsewhere = F.coalesce(juris != place, F.lit(False))
    wrong = F.when(elsewhere, "wrong-jurisdiction").otherwise("wrong-family") if s & PLACE else F.lit("wrong-family")
    absent = F.lit("not-measured") if s & UNREPORTED else None
    kind = F.when(~seen, "miss").when(family.isNull(), absent if absent is not None else F.lit("wrong-family")).when(family != F.col("family"), wrong)
    kind = kind.when(place.isNotNull() & juris.isNull(), absent if absent is not None else F.lit("wrong-jurisdiction")).otherwise(F.when(elsewhere, "wrong-jurisdiction").otherwise("correct"))
    told = flag if s & UNREPORTED else F.coalesce(flag, F.lit(False))
    told = F.when(seen, told).when(F.lit(not s & CAPABILITY) | (F.col("cap_sensitivity") == "supported"), F.lit(False))
    mood = F.when(told.isNull(), "not-measured").when((F.col("sensitivity") == "sensitive") == told, "correct").when(told, "false-positive").otherwise("miss")
    if s & CAPABILITY:
        kind = F.when(capabilities.rules_out_type(F.col("family_state"), F.col("place_state")), "not-measured").otherwise(kind)
        mood = F.when(F.col("cap_sensitivity") == "unsupported", "not-measured").otherwise(mood)
    span = F.when(seen, ranges.relation(F.col("exp_start"), F.col("exp_end"), f["f_start"], f["f_end"])).otherwise("miss")
    return F.struct(kind.alias("type_state"), mood.alias("sensitivity_state"), span.alias("range_state"))


def attributed(outcomes: DataFrame, findings: DataFrame) -> DataFrame:
    """The outcomes that can be read both ways, with a column ``switches``: 0 if both readings agree, null if no setting explains the difference.

    outcomes: what ``matching.assess`` gives; those are read whose scanner measured, whose occurrence is located and valid, and whose sensitivity is settled.
    Of several settings of equally few switches the one with the lower number counts.
    """
    rows = outcomes.where(capabilities.measures() & F.col("exp_start").isNotNull() & (F.col("type_expectation") == "valid") & F.col("sensitivity").isin("sensitive", "non-sensitive"))
    parts = ("f_start", "f_end", "f_family", "f_jurisdiction", "f_sensitive")
    e = rows.select("variant_id", "occurrence_id", "exp_start", "exp_end", "family", "jurisdiction").distinct()
    met = matching.candidates(e, findings).groupBy(*matching.KEYS).agg(F.min(matching.preference()).alias("closest"), F.min(F.struct("emission", *parts)).alias("first"))
    rows = rows.join(met, list(matching.KEYS), "left")
    now = F.struct("type_state", "sensitivity_state", "range_state")
    fits = [F.when(_reading(s) == now, F.struct(F.lit(s.bit_count()).alias("bits"), F.lit(s).alias("switches"))) for s in SETTINGS]
    return rows.withColumn("switches", F.array_min(F.array(*fits))["switches"]).drop("closest", "first")


def census(rows: DataFrame) -> DataFrame:
    """(scanner_id, switches, n, case_id, variant_id, occurrence_id) of ``attributed``: how many rows a setting explains, and the least of them."""
    least = F.min(F.struct("case_id", "variant_id", "occurrence_id"))
    return rows.groupBy("scanner_id", "switches").agg(F.count("*").alias("n"), least.alias("x")).select("scanner_id", "switches", "n", "x.*")
