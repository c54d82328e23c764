from pyspark.sql import functions as F

from tallyspan.functions import identity
from tallyspan.operators import generate, projection, verify


def test_a_roster_without_defects_and_an_empty_one(spark):
    make = spark.createDataFrame
    cases = make([("a", "x"), ("b", "y")], "case_id string, family string")
    good, none = make([("a", "v"), ("b", "w")], "case_id string, view string"), make([], "case_id string, control_class string")
    assert projection.roster_defects(cases, good, none, ["v", "w"]).count() == 0
    bad = make([("a", None), ("a", "v"), (None, "v"), ("c", "v")], "case_id string, view string")
    got = {tuple(r) for r in projection.roster_defects(cases, bad, none, ["v", "w"]).collect()}
    assert got == {("a", "view-not-required"), ("a", "duplicate-assignment"), ("b", "unassigned-case"), (None, "unknown-case"), ("c", "unknown-case"), ("w", "empty-required-view")}


def test_the_family_of_a_case(spark):
    rows = [("a", "x", None), ("a", "x", None), ("b", "x", None), ("b", "y", None), ("c", "x", "z"), ("c", "y", "z"), ("d", None, None), ("d", "x", None)]
    got = projection.case_families(spark.createDataFrame(rows, "case_id string, family string, target string")).collect()
    assert {tuple(r) for r in got} == {("a", "x"), ("b", None), ("c", "z"), ("d", None)}


def test_stored_cells(spark):
    cell = "scanner_id long, view string, family string, cases long, variants long, occurrences long"
    wanted = spark.createDataFrame([(0, "v", f, 2, 3, 4) for f in "abcd"], cell)
    stored = spark.createDataFrame([(0, "v", "a", 2, 3, 4), (0, "v", "b", 2, 3, 5), (0, "v", "c", 1, 3, 4), (0, "v", "e", 2, 3, 4)], cell)
    got = {(r.family, r.code) for r in projection.compare_cells(stored, wanted).collect()}
    assert got == {("b", "projection-pooled-denominator"), ("c", "count-mismatch"), ("d", "count-mismatch"), ("e", "count-mismatch")}
    totals, scanners = spark.createDataFrame([(8, 12, 16)], "cases long, variants long, occurrences long"), spark.createDataFrame([(0,), (1,)], "scanner_id long")
    got = {tuple(r) for r in projection.sum_defects(stored, totals, scanners, ["v"]).collect()}
    assert got == {(0, None, "projection-pooled-denominator"), (1, "v", "projection-view-missing"), (1, None, "count-mismatch")}


def test_a_verdict_takes_the_place_of_an_action_where_it_may(spark):
    cols = "scanner_id long, variant_id long, occurrence_id long, status string, cap_action string, text_negative boolean, action_state string, action string"
    rows = [(0, 1, 0, "complete", "sanitized-output", False), (0, 2, 0, "complete", "sanitized-output", True), (1, 1, 0, "unstable", "sanitized-output", False), (2, 1, 0, "complete", "reported", False), (0, 3, 0, "complete", "sanitized-output", False)]
    told = spark.createDataFrame([(s, v, 0, "removed") for s in range(3) for v in (1, 2)], "scanner_id long, variant_id long, occurrence_id long, verdict string")
    out = projection.with_verdicts(spark.createDataFrame([(*r, "reported", "redact") for r in rows], cols), told).collect()
    assert {(r.scanner_id, r.variant_id): (r.action_state, r.action, r.verdict) for r in out} == {
        (0, 1): ("output-verified", None, "removed"),
        **{k: ("reported", "redact", None) for k in ((0, 2), (1, 1), (2, 1), (0, 3))},
    }


def test_derived_values(spark):
    rows = spark.createDataFrame([("s", "D-AAD", 1200, 2), (None, "", 0, 3), ("s", "xyz", 5, 13), ("t", "ÄDA", -1, 0)], "seed string, pattern string, m long, s int")
    drawn, kept = identity.patterned(F.col("seed"), F.col("pattern")), identity.scaled_decimal(F.col("m"), F.col("s"))
    got = rows.select(drawn.alias("d"), kept.alias("k")).collect()

    import hashlib

    def want(seed, pattern):
        n, out = 0, ""
        for c in pattern:
            if c in "DA":
                v = int(hashlib.sha256(f"{seed}/{n}".encode()).hexdigest()[:8], 16)
                c, n = (str(v % 10) if c == "D" else "ABCDEFGHIJKLMNOPQRSTUVWXYZ"[v % 26]), n + 1
            out += c
        return out

    assert [r.d for r in got] == [want("s", "D-AAD"), "", "xyz", want("t", "ÄDA")]
    assert [r.k and tuple(r.k) for r in got] == [(12, 0), (0, 0), None, None]


def test_order_and_states_of_observations(spark):
    caps = "scanner_id long, status string, replays int, agreed boolean, cap_ranges string, cap_family string, cap_jurisdiction string, cap_sensitivity string"
    full = ("supported",) * 4
    scanners = spark.createDataFrame([(0, "complete", 2, True, *full), (1, "error", 0, True, *full), (2, "complete", None, True, *full), (3, "unavailable", 1, True, *full)], caps)
    cols = "scanner_id long, variant_id long, emission long, f_start long, f_end long, f_family string, f_jurisdiction string, f_sensitive boolean, f_action string"
    findings = [(0, 1, 0, 0, 5, None, None, None, None), (0, 1, 1, 0, 5, "x", None, None, None), (0, 2, 0, 0, 5, "x", None, None, None), (0, 2, 1, 0, 5, None, None, None, None), (0, 3, 0, None, 5, None, None, None, None)]
    got = {tuple(r) for r in verify.observation_defects(scanners, spark.createDataFrame(findings, cols)).collect()}
    assert got == {(1, None, "status-inconsistent"), (2, None, "status-inconsistent"), (0, 2, "non-canonical-order"), (0, 3, "range-invalid")}


def test_validators_and_references(spark):
    rows = [("type-validation", "us-ssn-allocation", "123456789", "valid"), ("type-validation", "us-ssn-allocation", "x", "valid"), ("type-validation", "other", "x", "valid"), ("type-validation", None, "x", "valid")]
    rows += [("reference-differential", *r[1:]) for r in rows] + [("mutation", None, "x", "valid")]
    df = spark.createDataFrame(rows, "method string, validator string, value string, type_expectation string").withColumn("version", F.lit(1))
    got = [(r.reason, r.review, r.strategy) for r in generate.held_against_validator(df).collect()]
    assert got == [
        (None, None, "authored"),
        ("validator-expectation-mismatch", None, None),
        (None, "validator-unavailable", "review-required"),
        ("missing-validator", None, None),
        (None, None, "authored"),
        (None, "reference-disagrees", "authored"),
        (None, "reference-unavailable", "review-required"),
        ("missing-reference", None, None),
    ]


def test_a_roster_is_counted_in_one_aggregate(spark):
    """Joins and aggregates of their own for each of eight defects held the cases several times in one task."""
    make, sizes = spark.createDataFrame, "case_id long, view string"
    cases = make([(i, None if i == 4 else "x") for i in range(6)], "case_id long, family string")
    roster = make([(0, "v"), (1, "v"), (1, "w"), (9, "v"), (9, "v"), (4, "w")], sizes)
    classes = make([(0, "d"), (0, "d"), (8, "d"), (None, "d")], "case_id long, control_class string")
    out = projection.roster_defects(cases, roster, classes, ["v", "w"])
    want = [("1", "duplicate-assignment"), *[("9", "unknown-case")] * 2, ("9", "duplicate-assignment"), *[(i, "unassigned-case") for i in "235"], ("4", "ambiguous-family"), ("0", "duplicate-control-assignment"), ("8", "unknown-control-case"), (None, "unknown-control-case")]
    assert sorted(map(str, map(tuple, out.collect()))) == sorted(map(str, want))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1 and plan.count("Aggregate") == 2
