"""Staged, fail-closed verification of evidence snapshots, many at once.

Every check gives its defects with their stage, and a snapshot fails where its least stage does: one keyed minimum over all defects, so a
later stage counts only for snapshots that passed all before, without a pass for each stage.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ranges

#: The stages in order, and origins of values that may be published.
STAGES = ("population", "files", "counts", "safety", "references", "fixtures")
SAFE_ORIGINS = ("reserved", "synthetic", "public-test")


def _found(rows: DataFrame, stage: str, code: Column, place: Column) -> DataFrame:
    return rows.select("snapshot", F.lit(STAGES.index(stage)).alias("stage"), code.alias("code"), place.cast("string").alias("place")).where("code is not null")


def manifest_defects(manifests: DataFrame) -> DataFrame:
    """manifests: (snapshot, population)."""
    return _found(manifests, "population", F.when(~F.col("population").eqNullSafe("public"), "population-not-public"), F.lit("population"))


def file_defects(listed: DataFrame, present: DataFrame) -> DataFrame:
    """Exactly the listed files, each of its length and number of records; both tables: (snapshot, path, bytes, records)."""
    sides = [df.select("snapshot", "path", F.struct("bytes", "records").alias(name)) for df, name in ((listed, "a"), (present, "b"))]
    rows = sides[0].join(sides[1], ["snapshot", "path"], "full")
    code = F.when(F.col("b").isNull(), "file-missing").when(F.col("a").isNull(), "file-unlisted").when(F.col("a.bytes") != F.col("b.bytes"), "file-length-mismatch")
    return _found(rows, "files", code.when(F.col("a.records") != F.col("b.records"), "record-count-mismatch"), F.col("path"))


def count_defects(counts: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """The counts that manifests state, (snapshot, key, n), against the tables' rows; a count that isn't stated is wrong as well."""
    sums = [df.groupBy("snapshot").agg(F.count("*").alias("held")).withColumn("key", F.lit(key)) for key, df in tables.items()]
    rows = counts.where(F.col("key").isin(*tables)).join(reduce(DataFrame.unionByName, sums), ["snapshot", "key"], "full")
    return _found(rows, "counts", F.when(~F.col("n").eqNullSafe(F.coalesce("held", F.lit(0))), "count-mismatch"), F.col("key"))


def safety_defects(rows: DataFrame) -> DataFrame:
    """rows: (snapshot, id, origin)."""
    return _found(rows, "safety", F.when(~F.coalesce(F.col("origin").isin(*SAFE_ORIGINS), F.lit(False)), "source-not-public-safe"), F.col("id"))


def reference_defects(rows: DataFrame, place: str, target: Column, known: DataFrame) -> DataFrame:
    """Rows whose target, or one of whose targets, known (snapshot, id) doesn't have in the same snapshot. Null targets name nothing."""
    many = dict(rows.select(target.alias("t")).dtypes)["t"].startswith("array")
    refs = rows.select("snapshot", F.col(place).alias("place"), (F.explode(target) if many else target).alias("id")).where("id is not null")
    gone = refs.join(known.select("snapshot", "id"), ["snapshot", "id"], "left_anti").distinct()
    return _found(gone, "references", F.lit("reference-unresolved"), F.col("place"))


def pair_defects(fixtures: DataFrame, skips: DataFrame) -> DataFrame:
    """A case and a rule meet once at most, as a fixture or as a skip, under the id case/rule."""
    both = fixtures.select("snapshot", "id", "case", "rule").union(skips.select("snapshot", "id", "case", "rule"))
    named = _found(both, "references", F.when(F.col("id") != F.concat_ws("/", "case", "rule"), "reference-unresolved"), F.col("id"))
    twice = both.groupBy("snapshot", "case", "rule").agg(F.count("*").alias("n"), F.max("id").alias("id")).where("n > 1")
    return named.union(_found(twice, "references", F.lit("reference-unresolved"), F.col("id")))


def _slice(text: Column, start: Column, end: Column) -> Column:
    return F.substring(F.encode(text, "UTF-8"), (start + 1).cast("int"), (end - start).cast("int"))


def fixture_defects(fixtures: DataFrame, cases: DataFrame, rules: DataFrame) -> DataFrame:
    """Fixtures against their case and their rule, each with the first defect: one three-way join.

    fixtures: (snapshot, id, case, rule, rule_version, evidence_class, content, byte_length, sha256, start, end, identity, sensitivity, derived); cases: (snapshot, id,
    text, start, end, identity, sensitivity, evidence_class); rules: (snapshot, id, version, mode). A rule that copies keeps the case's expectation and its
    value; one that derives says that it does, and leaves identity and sensitivity open. Fixtures without a case or rule are ``reference_defects``.
    """
    c = cases.select("snapshot", F.col("id").alias("case"), F.struct("text", "start", "end", "identity", "sensitivity", "evidence_class").alias("c"))
    r = rules.select("snapshot", F.col("id").alias("rule"), F.struct("version", "mode").alias("r"))
    rows = fixtures.join(c, ["snapshot", "case"]).join(r, ["snapshot", "rule"])
    start, end, content = F.col("start"), F.col("end"), F.col("content")
    copied = ~F.col("derived") & F.col("identity").eqNullSafe(F.col("c.identity")) & F.col("sensitivity").eqNullSafe(F.col("c.sensitivity"))
    value = _slice(content, start, end).eqNullSafe(_slice(F.col("c.text"), F.col("c.start"), F.col("c.end")))
    derived = F.col("derived") & (F.col("identity") == "not-established") & (F.col("sensitivity") == "context-dependent") & start.isNull()
    agrees = F.when(F.col("r.mode") == "copy", copied & value).otherwise(derived)
    code = (
        F.when((F.col("rule_version") != F.col("r.version")) | (F.col("evidence_class") != F.col("c.evidence_class")), "reference-unresolved")
        .when(F.octet_length(content) != F.col("byte_length"), "fixture-length-mismatch")
        .when(F.sha2(F.encode(content, "UTF-8"), 256) != F.col("sha256"), "fixture-digest-mismatch")
        .when(start.isNotNull() & F.coalesce(ranges.range_error(content, start, end).isNotNull() | (start < 0), F.lit(True)), "span-invalid")
        .when(~F.coalesce(agrees, F.lit(False)), "fixture-expectation-mismatch")
    )
    return _found(rows, "fixtures", code, F.col("id"))


def first_failures(snapshots: DataFrame, defects: list[DataFrame]) -> DataFrame:
    """(snapshot, stage, code, place, defects): the first failure of each snapshot, by stage, then code and place; all null and 0 for a sound one.

    defects counts those of the failing stage alone, as what comes after it was never reached.
    """
    every = reduce(DataFrame.unionByName, defects).groupBy("snapshot", "stage").agg(F.min(F.struct("code", "place")).alias("least"), F.count("*").alias("n"))
    first = every.groupBy("snapshot").agg(F.min(F.struct("stage", "least", "n")).alias("f"))
    name = F.element_at(F.array(*map(F.lit, STAGES)), F.col("f.stage") + 1)
    rows = snapshots.select("snapshot").distinct().join(first, "snapshot", "left")
    return rows.select("snapshot", F.when(F.col("f").isNotNull(), name).alias("stage"), "f.least.code", "f.least.place", F.coalesce("f.n", F.lit(0)).cast("long").alias("defects"))


def coverage(kinds: DataFrame, cases: DataFrame, fixtures: DataFrame) -> DataFrame:
    """(snapshot, kind, cases, fixtures) for every kind (snapshot, id), also those without cases; fixtures count for their case's kind."""
    made = fixtures.groupBy("snapshot", F.col("case").alias("id")).agg(F.count("*").alias("made"))
    held = cases.select("snapshot", "id", "kind").join(made, ["snapshot", "id"], "left")
    tally = held.groupBy("snapshot", "kind").agg(F.count("*").alias("cases"), F.sum(F.coalesce("made", F.lit(0))).alias("fixtures"))
    rows = kinds.select("snapshot", F.col("id").alias("kind")).join(tally, ["snapshot", "kind"], "left")
    return rows.select("snapshot", "kind", F.coalesce("cases", F.lit(0)).cast("long").alias("cases"), F.coalesce("fixtures", F.lit(0)).cast("long").alias("fixtures"))
