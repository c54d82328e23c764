"""Detectors by hand, and replays that differ."""

import pytest

from tallyspan.operators import scan

CARD = "4111111111111111"


def test_findings_have_byte_offsets(spark):
    texts = [(1, f"é {CARD} 4111111111111112 a@b.example"), (2, ""), (3, None), (4, "no")]
    df = spark.createDataFrame(texts, "variant_id long, text string")
    found = scan.scan(df, {5: scan.luhn("[0-9]{12,19}", "card"), 7: scan.pattern("[a-z]+@[a-z.]+", "email")}, replays=1)
    got = [(r.scanner_id, r.variant_id, r.emission, r.f_start, r.f_end, r.f_family, r.f_sensitive) for r in found.collect()]
    assert got == [(5, 1, 0, 3, 19, "card", True), (7, 1, 0, 37, 48, "email", None)]
    assert scan.scan(df.limit(0), {5: scan.luhn("[0-9]+", "card")}).count() == 0


def test_replays(spark):
    steady = scan.pattern("[0-9]", "digit")
    df = spark.createDataFrame([(1, "1 2 3"), (2, "1"), (3, "none")], "variant_id long, text string")
    found = scan.scan(df, {0: steady, 1: scan.flaky(steady, 2), 2: scan.pattern("zz", "z")}, replays=3).persist()
    assert {tuple(r) for r in scan.unstable_inputs(found, 3).collect()} == {(1, 1)}
    assert sorted(tuple(r) for r in scan.statuses(spark, {0: steady, 1: steady, 2: steady}, found, 3).collect()) == [(0, "complete", 0), (1, "unstable", 1), (2, "complete", 0)]


def test_too_many_findings_fail_the_query(spark):
    df = spark.createDataFrame([(1, "1" * 50)], "variant_id long, text string")
    with pytest.raises(Exception, match="more than 10 findings"):
        scan.scan(df, {0: scan.pattern("1", "d")}, most=10).collect()
