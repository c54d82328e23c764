"""Differences between the older and the present reading, by hand and over a whole population."""

import __spark_entry__ as entry
from tallyspan.operators import attribution, matching

E = "case_id long, variant_id long, occurrence_id long, method string, language string, jurisdiction string, family string, context_class string, text_negative boolean, exp_start long, exp_end long, type_expectation string, sensitivity string"
S = "scanner_id long, status string, cap_ranges string, cap_family string, cap_jurisdiction string, cap_sensitivity string, cap_action string, families map<string,string>, jurisdictions map<string,string>"
F_ = "scanner_id long, variant_id long, case_id long, emission long, f_start long, f_end long, f_family string, f_jurisdiction string, f_sensitive boolean, f_action string"


def test_by_hand(spark):
    found = [
        [(2, 6, "email", None, True)],  # both agree
        [(0, 9, "card", None, False), (2, 6, "email", None, True)],  # the closest comes second
        [(2, 6, "email", None, None)],  # sensitivity isn't reported
        [(0, 9, "card", None, True), (2, 6, None, None, True)],  # order, and then a family that isn't reported
        [(2, 6, "card", "GB", True)],  # wrong in both; the case is in the US
        [],
    ]
    expectations = [(i, i, 0, "m", "en", "US" if i == 4 else None, "email", "neutral", False, 2, 6, "valid", "sensitive") for i in range(len(found))]
    scanners = [(0, "complete", "supported", "supported", "supported", "supported", "reported", {"email": "supported"}, {}), (1, "complete", "supported", "supported", "supported", "supported", "reported", {"email": "unsupported"}, {}), (2, "error", "supported", "supported", "supported", "supported", "reported", {}, {})]
    rows = [(s, i, i, n, a, b, fam, j, flag, None) for s in (0, 1) for i, fs in enumerate(found) for n, (a, b, fam, j, flag) in enumerate(fs)]
    f = spark.createDataFrame(rows, F_)
    outcomes = matching.assess(spark.createDataFrame(expectations, E), spark.createDataFrame(scanners, S), f)
    told = attribution.attributed(outcomes, f)
    got = {(r.scanner_id, r.case_id): r.switches for r in told.collect()}
    O, U, C, P = attribution.ORDER, attribution.UNREPORTED, attribution.CAPABILITY, attribution.PLACE
    assert [got[0, i] for i in range(6)] == [0, O, U, O | U, P, 0]
    assert [got[1, i] for i in range(6)] == [C, O | C, U | C, O | U, C, C]
    assert len(got) == 12 and {(r.scanner_id, r.switches, r.n, r.case_id) for r in attribution.census(told).where("scanner_id = 0").collect()} == {(0, 0, 2, 0), (0, O, 1, 1), (0, U, 1, 2), (0, O | U, 1, 3), (0, P, 1, 4)}


def test_a_row_that_nothing_explains_shows(spark):
    e = spark.createDataFrame([(1, 1, 0, "m", "en", None, "email", "neutral", False, 2, 6, "valid", "sensitive")], E)
    s = spark.createDataFrame([(0, "complete", "supported", "supported", "supported", "supported", "reported", {"email": "supported"}, {})], S)
    f = spark.createDataFrame([(0, 1, 1, 0, 2, 6, "email", None, True, None)], F_)
    outcomes = matching.assess(e, s, f).replace("exact", "partial", ["range_state"])
    assert [r.switches for r in attribution.attributed(outcomes, f).collect()] == [None]


def test_all_differences_are_explained(spark):
    rows = entry.queries()["difference_census"](spark, "/root/testdata/sf0.001").collect()
    assert all(r.switches is not None for r in rows) and {r.switches & attribution.ORDER for r in rows} == {0, 1}
