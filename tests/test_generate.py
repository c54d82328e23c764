from tallyspan.operators import generate

SCHEMA = """case_id long, text string, exp_start long, exp_end long, family string, jurisdiction string, method string, sensitivity string, competing array<string>,
evidence_method string, benign_class string, evidence_classes array<string>, cross_family boolean, checks array<struct<validator:string,version:int,expected:string>>"""
GOOD = dict(text="né SYNTHETIC-1236 x", exp_start=4, exp_end=18, family="pii:us:ssn", jurisdiction="US", method="schema-only", sensitivity="sensitive", competing=None)
GOOD |= dict(evidence_method=None, benign_class=None, evidence_classes=None, cross_family=False, checks=None)
HIT = dict(method="jurisdiction-collision", competing=["pii:us:card"])
BENIGN = dict(method="pii-benign", sensitivity="non-sensitive")
CASES = [
    ({}, None),
    (dict(text="x" * 20), None),
    (dict(text="x" * 21), "text-too-large"),
    (dict(text="é" * 11), "text-too-large"),
    (dict(exp_start=None), "range-invalid"),
    (dict(exp_end=4), "range-invalid"),
    (dict(exp_end=21), "range-out-of-bounds"),
    (dict(exp_start=2), "range-not-on-char-boundary"),
    (dict(jurisdiction="GB"), "family-scope-mismatch"),
    (dict(family="pii:global:ssn"), "family-scope-mismatch"),
    (dict(evidence_method="mutation"), "evidence-role-mismatch"),
    (HIT, None),
    (HIT | dict(competing=[]), "invalid-collision"),
    (HIT | dict(competing=None), "invalid-collision"),
    (HIT | dict(competing=["pii:us:card", "pii:us:ssn"]), "invalid-collision"),
    (HIT | dict(competing=[f"pii:us:f{i}" for i in range(33)]), "invalid-collision"),
    (HIT | dict(competing=[f"pii:us:f{i % 32}" for i in range(40)]), None),
    (HIT | dict(evidence_method="jurisdiction-collision", cross_family=True, checks=[("synthetic-mod10", 1, "valid")]), "missing-evidence-checks"),
    (HIT | dict(checks=[("synthetic-mod10", 1, "valid")]), None),
    (HIT | dict(checks=[("synthetic-mod10", 1, "valid"), ("synthetic-mod10", 1, "invalid")]), "validator-check-mismatch"),
    (BENIGN, None),
    (BENIGN | dict(sensitivity="sensitive"), "not-non-sensitive"),
    (BENIGN | dict(evidence_method="pii-benign", benign_class="reserved", evidence_classes=["placeholder"]), "evidence-role-mismatch"),
    (BENIGN | dict(evidence_method="pii-benign", benign_class="placeholder", evidence_classes=["placeholder"]), None),
    (BENIGN | dict(checks=[("synthetic-mod10", 2, "valid")]), "validator-check-unavailable"),
]


def test_guards_read_the_case(spark):
    """Ids that the old rule refused or passed by remainder are all multiples of 62 here."""
    rows = [tuple((dict(GOOD, case_id=62 * i) | more)[c.split()[0]] for c in ("case_id text exp_start exp_end family jurisdiction method sensitivity competing evidence_method benign_class evidence_classes cross_family checks").split()) for i, (more, _) in enumerate(CASES)]
    got = {r.case_id // 62: r.reason for r in generate.guarded(spark.createDataFrame(rows, SCHEMA), 20).collect()}
    assert [got[i] for i in range(len(CASES))] == [want for _, want in CASES]
