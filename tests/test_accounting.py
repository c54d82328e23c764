"""Twelve cases whose ten metrics were worked out by hand."""

from pyspark.sql import functions as F

from tallyspan.operators import accounting

NM, NA = "not-measured", "not-applicable"
TRIO = ("sensitive", "neutral", "non-sensitive")


def trio(case, authored, types, moods, spans):
    return [(case, "context-discrimination", "en", None, c, t, s, *x) for c, t, s, *x in zip(TRIO, ["valid"] * 3, authored, types, moods, spans)]


ROWS = [
    ("c01", "type-validation", "en", None, "neutral", "valid", "sensitive", "correct", "correct", "exact"),
    ("c01", "type-validation", "en", None, "neutral", "invalid", "sensitive", "invalid-correct", "correct", "miss"),
    ("c02", "type-validation", "ko", "US", "neutral", "valid", "sensitive", "miss", "miss", "miss"),
    ("c03", "type-validation", "en", None, "neutral", "valid", "non-sensitive", "wrong-family", "false-positive", "partial"),
    ("c04", "pii-benign", "en", None, "neutral", "invalid", "non-sensitive", "invalid-correct", "correct", "miss"),
    ("c05", "pii-benign", "en", None, "neutral", "invalid", "non-sensitive", "invalid-accepted", "false-positive", "exact"),
    ("c06", "pii-benign", "en", None, "neutral", "invalid", "non-sensitive", NM, NM, NA),
    ("c07", "jurisdiction-collision", "ko", "US", "neutral", "valid", "sensitive", "correct", "correct", "exact"),
    ("c08", "jurisdiction-collision", "ko", "US", "neutral", "valid", "sensitive", "wrong-jurisdiction", "correct", "exact"),
    *trio("c09", ("sensitive", "not-established", "non-sensitive"), ["correct"] * 3, ("correct", "unresolved", "correct"), ["exact"] * 3),
    *trio("c10", ("sensitive", "not-established", "non-sensitive"), ["correct"] * 3, ("miss", "unresolved", "correct"), ["exact"] * 3),
    *trio("c11", ("sensitive", "not-established", "non-sensitive"), (NM, NM, "correct"), (NM, NM, "correct"), (NA, NA, "exact")),
    *trio("c12", ("not-established", "not-established", "non-sensitive"), ["correct"] * 3, ("unresolved", "unresolved", "correct"), ["exact"] * 3),
]
WANT = {
    "type-miss-rate": (9, 8, 1, 0, 1, 3, 12, 8, "partial", 125000, 470895),
    "wrong-family-rate": (9, 8, 1, 0, 1, 3, 12, 8, "partial", 125000, 470895),
    "wrong-jurisdiction-rate": (3, 3, 1, 0, 0, 9, 12, 3, "measured", None, None),
    "sensitive-miss-rate": (7, 6, 2, 0, 1, 5, 12, 6, "partial", 333333, 700012),
    "non-sensitive-flag-rate": (8, 7, 2, 0, 1, 4, 12, 7, "partial", 285714, 641071),
    "context-discrimination-rate": (4, 2, 1, 1, 1, 0, 4, 2, "partial", None, None),
    "benign-suppression-rate": (3, 2, 1, 0, 1, 9, 12, 2, "partial", None, None),
    "jurisdiction-collision-rate": (2, 2, 1, 0, 0, 10, 12, 2, "measured", None, None),
    "range-collateral-rate": (8, 7, 1, 0, 1, 4, 12, 7, "partial", 142857, 513135),
    "measurable-share": (24, 17, 17, 4, 3, 0, 24, 24, "partial", 708333, 508319),
}
NAMES = "case_id method language jurisdiction context_class type_expectation sensitivity type_state sensitivity_state range_state".split()


def test_hand_worked_metrics_in_any_order(spark):
    df = spark.createDataFrame(ROWS, ", ".join(f"{n} string" for n in NAMES)).withColumn("scanner_id", F.lit(0))
    for rows in (df, df.repartition(5).orderBy(F.rand(3))):
        out = accounting.published(accounting.tallies(accounting.buckets(accounting.case_standings(rows))))
        got = {r.metric: tuple(r[c] for c in "eligible measured numerator unresolved not_measured not_applicable total n status point bound".split()) for r in out.where("stratum = 'overall'").collect()}
        assert got == WANT


def test_cases_counted_before_they_are_dealt_into_metrics(spark):
    rows = spark.createDataFrame(ROWS * 2, ", ".join(f"{n} string" for n in NAMES)).withColumn("scanner_id", F.lit(0))
    cases = accounting.case_standings(rows.withColumn("case_id", F.concat("case_id", F.length("method").cast("string"))))
    one = accounting.tallies(accounting.buckets(cases))
    many = accounting.tallies(accounting.buckets(accounting.alike(cases))).select(one.columns)
    assert one.exceptAll(many).count() == many.exceptAll(one).count() == 0
