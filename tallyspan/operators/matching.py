"""Matching expectations with findings, and the four axes of each outcome.

expectations and findings meet once, on the variant, and where only ranges count also on a bin of positions (see ``intervals``); the primary finding of an occurrence is the least
struct in order of preference, so no window sorts whole groups. Scanners come from their table, which is small. Duplicated findings are kept and counted.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import capabilities, ranges
from . import intervals

KEYS = ("scanner_id", "variant_id", "occurrence_id")


def matrix(expectations: DataFrame, scanners: DataFrame) -> DataFrame:
    """Every scanner against every occurrence; scanners are few by contract (32 at most)."""
    return expectations.crossJoin(F.broadcast(scanners))


EXPECTED, REPORTED = ("exp_start", "exp_end"), ("f_start", "f_end")
FOUND = ("scanner_id", *REPORTED, "f_family", "f_jurisdiction", "f_sensitive", "f_action")
#: What findings name, and the columns of all that those of an occurrence named.
SAID = {"family": "families_said", "jurisdiction": "jurisdictions_said"}


def candidates(expectations: DataFrame, findings: DataFrame) -> DataFrame:
    """Pairs of a located occurrence and a finding of its variant whose ranges overlap, for each scanner that has findings."""
    return intervals.overlapping(expectations, findings.drop("case_id"), "variant_id", EXPECTED, REPORTED).drop("bin")


def of_complete(findings: DataFrame, scanners: DataFrame) -> DataFrame:
    """The findings of scanners that measured something."""
    return findings.join(F.broadcast(scanners.where(capabilities.measures()).select("scanner_id")), "scanner_id", "left_semi")


def preference(of: Callable[[str], Column] = F.col) -> Column:
    """Order of preference among an occurrence's candidates: closeness, identity, completeness, then the finding itself. ``of`` gives a finding's column by its name."""
    rank, tight = ranges.closeness(F.col("exp_start"), F.col("exp_end"), of("f_start"), of("f_end"))
    same = F.coalesce(of("f_family") == F.col("family"), F.lit(False))
    place = F.col("jurisdiction").isNull() | F.coalesce(of("f_jurisdiction") == F.col("jurisdiction"), F.lit(False))
    identity = F.when(same, F.when(place, 0).otherwise(1)).otherwise(2)
    given = sum(of(c).isNotNull().cast("int") for c in ("f_jurisdiction", "f_sensitive", "f_action"))
    cols = [of(c).alias(c) for c in ("f_start", "f_end", "f_family", "f_jurisdiction", "f_sensitive", "f_action")]
    return F.struct(rank.alias("rank"), tight.alias("tight"), identity.alias("identity"), (3 - given).alias("incomplete"), *cols)


def primaries(pairs: DataFrame) -> DataFrame:
    """One row an occurrence: its primary finding, the number of candidates, and what they named."""
    here = F.col("f_start").isNotNull()
    sorted_names = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    return pairs.groupBy(*KEYS).agg(F.min(F.when(here, preference())).alias("p"), F.count("f_start").alias("n"), sorted_names("f_family").alias("families"), sorted_names("f_jurisdiction").alias("jurisdictions"))


def type_state(n: Column, primary: Column, unsupported: Column) -> Column:
    named, place, juris = primary["f_family"], primary["f_jurisdiction"], F.col("jurisdiction")
    other = F.when(place.isNotNull() & juris.isNotNull() & (place != juris), "wrong-jurisdiction")
    valid = (
        F.when(n == 0, "miss")
        .when(named.isNull(), "not-measured")
        .when(named != F.col("family"), F.coalesce(other, F.lit("wrong-family")))
        .when(juris.isNotNull() & place.isNull(), "not-measured")
        .otherwise(F.coalesce(other, F.lit("correct")))
    )
    return (
        F.when(unsupported, "not-measured")
        .when(F.col("type_expectation") == "not-established", "unresolved")
        .when(F.col("type_expectation") == "invalid", F.when(n > 0, "invalid-accepted").otherwise("invalid-correct"))
        .otherwise(valid)
    )


def sensitivity_state(n: Column, flag: Column) -> Column:
    cap, wanted = F.col("cap_sensitivity"), F.col("sensitivity")
    told = F.when(n > 0, flag).when(cap == "supported", F.lit(False))
    judged = F.when(told.isNull(), "not-measured").when((wanted == "sensitive") == told, "correct").when(told, "false-positive").otherwise("miss")
    return F.when(cap == "unsupported", "not-measured").when(wanted.isin("not-established", "context-dependent"), "unresolved").otherwise(judged)


def found_by_scanner(expectations: DataFrame, scanners: DataFrame, findings: DataFrame, observed: bool = True, within: str = "variant_id") -> DataFrame:
    """Every scanner against every occurrence, with n, p, lacks and flag: what the scanner reported of it.

    The findings of a variant, or of its case, are gathered in one array, as both have few by contract, and meet its occurrences there; so an occurrence is neither
    repeated for each finding nor sorted again to be folded. A located occurrence takes the findings whose ranges overlap it; one about the whole
    text takes those of its family, and of its jurisdiction if it has one. They are folded by scanner into a map before the occurrence is repeated for each scanner,
    which then only looks its own up; so no array is copied or gone through for each scanner. What they named is left out unless ``observed``.
    """
    gathered = findings.where("scanner_id is not null").groupBy(within).agg(F.collect_list(F.struct("variant_id", *FOUND)).alias("found"))
    rows = expectations.join(gathered, within, "left")
    whole, juris = F.col("text_negative"), F.col("jurisdiction")
    same = lambda x: x["f_family"] == F.col("family")
    own = lambda x: x["variant_id"] == F.col("variant_id")

    def hit(x: Column) -> Column:
        scoped = x["f_start"].isNotNull() & same(x) & (juris.isNull() | (x["f_jurisdiction"] == juris))
        return own(x) & F.coalesce(F.when(whole, scoped).otherwise(ranges.overlaps(F.col("exp_start"), F.col("exp_end"), x["f_start"], x["f_end"])), F.lit(False))

    def silent(x: Column) -> Column:
        return own(x) & F.coalesce(x["f_start"].isNotNull() & (x["f_family"].isNull() | (same(x) & juris.isNotNull() & x["f_jurisdiction"].isNull())), F.lit(False))

    flag = lambda x: F.when(x["f_sensitive"], 0).when(x["f_sensitive"].isNull(), 1).otherwise(2)

    def fold(scanner: Column) -> Column:
        mine = F.filter("hits", lambda x: x["scanner_id"] == scanner)
        names = lambda c: F.array_join(F.array_sort(F.array_distinct(F.transform(mine, lambda x: x["f_" + c]))), ",")
        told = [names(c).alias(said) for c, said in SAID.items()] if observed else []
        p = F.when(~whole, F.array_min(F.transform(mine, lambda x: preference(lambda c: x[c]))))
        return F.struct(F.size(mine).cast("long").alias("n"), p.alias("p"), F.when(whole, F.array_min(F.transform(mine, flag))).alias("flag"), *told)

    rows = rows.withColumn("hits", F.filter("found", hit)).withColumn("silent", F.when(whole, F.transform(F.filter("found", silent), lambda x: x["scanner_id"]))).drop("found")
    heard = F.array_distinct(F.transform("hits", lambda x: x["scanner_id"]))
    rows = rows.withColumn("heard", heard).withColumn("seen", F.map_from_arrays("heard", F.transform("heard", fold))).drop("hits", "heard")
    rows = rows.crossJoin(F.broadcast(scanners)).withColumn("lacks", whole & F.coalesce(F.array_contains("silent", F.col("scanner_id")), F.lit(False)))
    rows = rows.withColumn("seen", F.try_element_at("seen", F.col("scanner_id")))
    told = {said: F.col("seen." + said) for said in SAID.values()} if observed else {}
    return rows.withColumns({"n": F.coalesce("seen.n", F.lit(0).cast("long")), "p": F.col("seen.p"), "flag": F.col("seen.flag"), **told}).drop("seen", "silent")


def assess(expectations: DataFrame, scanners: DataFrame, findings: DataFrame, observed: bool = True, within: str = "variant_id") -> DataFrame:
    """One outcome for every scanner and occurrence.

    scanners: (scanner_id, status, cap_ranges, cap_family, cap_jurisdiction, cap_sensitivity, cap_action, families, jurisdictions), the last two maps
    from a name to its state. One that isn't complete or reports no ranges measured nothing, and its findings aren't read. No
    candidate of an occurrence about the whole text is an answer only where the scanner supports the family and the jurisdiction.
    What the candidates named (families, jurisdictions) is left out unless ``observed``. ``within`` names a column of both tables
    that the variant decides, as its case: they meet by it, so findings that are dealt by it already, and a fold by it afterwards, need no shuffle.
    """
    measured = capabilities.measures()
    every = found_by_scanner(expectations, scanners, of_complete(findings, scanners), observed, within)
    of_family, of_place = capabilities.expected_states(F.col("family"), F.col("jurisdiction"))
    kept = [c for c in scanners.columns if c not in ("families", "jurisdictions")]
    said = {c: F.col(c + "_said") for c in ("families", "jurisdictions")}
    every = every.withColumns({"family_state": of_family, "place_state": of_place})

    p, n, whole, ranged = F.col("p"), F.col("n"), F.col("text_negative"), F.col("exp_start").isNotNull()
    nothing = F.lit(None).cast("string")
    states = F.col("family_state"), F.col("place_state")
    gaps, unsupported = F.col("lacks") | ~capabilities.classifies(*states), capabilities.rules_out_type(*states)
    kind, mood = type_state(n, p, unsupported), sensitivity_state(n, F.when(whole, F.when(F.col("flag") == 0, True).when(F.col("flag") == 2, False)).otherwise(p["f_sensitive"]))
    span = F.when(n > 0, ranges.relation(F.col("exp_start"), F.col("exp_end"), p["f_start"], p["f_end"])).otherwise("miss")
    judged = measured & ~whole & ranged & (F.col("cap_action") != "unavailable")
    # in two steps: what is read twice is worked out once, and a generated method over 8000 bytes is never compiled by the virtual machine
    every = every.withColumns({"kind": kind, "mood": mood, "span": span, "gaps": gaps, "act": F.when(judged & (n > 0), p["f_action"]), "judged": judged})
    kind, mood, act = F.col("kind"), F.col("mood"), F.col("act")
    return every.select(
        *expectations.columns,
        *kept,
        *states,
        F.when(~measured | (whole & (kind == "invalid-correct") & F.col("gaps")), "not-measured").otherwise(kind).alias("type_state"),
        F.when(~measured | (whole & (mood == "correct") & (F.col("sensitivity") == "non-sensitive") & F.col("lacks")), "not-measured").otherwise(mood).alias("sensitivity_state"),
        F.when(~measured | whole, "not-applicable").when(~ranged, "unresolved").otherwise(F.col("span")).alias("range_state"),
        F.when(~F.col("judged"), "not-measured").when(act.isNotNull(), "reported").otherwise("no-action-reported").alias("action_state"),
        F.when(act.isNotNull(), act).otherwise(nothing).alias("action"),
        n.alias("finding_count"),
        *([F.coalesce(c, F.lit("")).alias(name) for name, c in said.items()] if observed else []),
    )


def gated(outcomes: DataFrame, held: DataFrame) -> DataFrame:
    """Outcomes whose type is not measured where the variant is held for review."""
    marks = held.select("variant_id").distinct().withColumn("held", F.lit(True))
    return outcomes.join(marks, "variant_id", "left").withColumn("type_state", F.when(F.col("held"), "not-measured").otherwise(F.col("type_state"))).drop("held")


FINDING = ("scanner_id", "variant_id", "emission", "f_start", "f_end")


def reported(expectations: DataFrame, findings: DataFrame) -> DataFrame:
    """Each finding that overlaps an occurrence, with the closest; ties go to the lowest occurrence."""
    e = expectations.where("exp_start is not null").select("variant_id", "occurrence_id", *EXPECTED)
    rank, tight = ranges.closeness(*map(F.col, (*EXPECTED, *REPORTED)))
    best = F.min(F.struct(rank.alias("rank"), tight.alias("tight"), F.col("occurrence_id"))).alias("best")
    return candidates(e, findings.select(*FINDING)).groupBy(*FINDING).agg(best)


def unmatched(expectations: DataFrame, findings: DataFrame) -> DataFrame:
    """The findings that overlap no occurrence of their variant."""
    e = expectations.where("exp_start is not null").select("variant_id", *EXPECTED)
    return findings.join(candidates(e, findings.select(*FINDING)).select(*FINDING).distinct(), list(FINDING), "left_anti")


def first_overlap(expectations: DataFrame, findings: DataFrame, scanners: DataFrame) -> DataFrame:
    """The older rule: the first finding in order of emission that overlaps decides, without regard to capabilities."""
    every = matrix(expectations.where("exp_start is not null"), scanners.where("status = 'complete'"))
    met = candidates(expectations.where("exp_start is not null").select("variant_id", "occurrence_id", *EXPECTED), findings)
    first = met.groupBy(*KEYS).agg(F.min(F.struct("emission", "f_start", "f_end", "f_family", "f_jurisdiction", "f_sensitive")).alias("p"))
    rows = every.join(first, list(KEYS), "left")
    p = F.col("p")
    same = p["f_family"] == F.col("family")
    place = F.col("jurisdiction").isNull() | F.coalesce(p["f_jurisdiction"] == F.col("jurisdiction"), F.lit(False))
    state = F.when(p.isNull(), "miss").when(~F.coalesce(same, F.lit(False)), "wrong-family").when(~place, "wrong-jurisdiction").otherwise("correct")
    return rows.select(*KEYS, "case_id", "method", state.alias("legacy_type"), F.coalesce(p["f_sensitive"], F.lit(False)).alias("legacy_flag"))
