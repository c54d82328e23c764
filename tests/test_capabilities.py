"""Every cell of the type, sensitivity and action axes against a plain version, scanner by scanner."""

from itertools import product

from pyspark.sql import functions as F

from tallyspan.operators import matching, verify

E = "case_id long, variant_id long, occurrence_id long, method string, language string, jurisdiction string, family string, context_class string, text_negative boolean, exp_start long, exp_end long, type_expectation string, sensitivity string"
S = "scanner_id long, status string, cap_ranges string, cap_family string, cap_jurisdiction string, cap_sensitivity string, cap_action string, families map<string,string>, jurisdictions map<string,string>"
F_ = "scanner_id long, variant_id long, case_id long, emission long, f_start long, f_end long, f_family string, f_jurisdiction string, f_sensitive boolean, f_action string"
CAPS = ("supported", "undeclared", "unsupported")


def state(entries, name, overall):
    return entries.get(name, "unsupported" if overall == "unsupported" else "undeclared")


def plain(e, s, found):
    """One finding at most."""
    _, _, _, _, _, place, family, _, whole, start, _, kind, mood = e
    _, status, c_ranges, c_family, c_place, c_mood, c_action, families, places = s
    if status != "complete" or c_ranges == "unsupported":
        return "not-measured", "not-measured", "not-applicable", "not-measured", None
    of_family, of_place = state(families, family, c_family), state(places, place, c_place) if place else "supported"
    hit = found if found and (found[6] == family and (not place or found[7] == place) if whole else start is not None and found[4] < e[10] and start < found[5]) else None
    lacks = whole and found is not None and (found[6] is None or (found[6] == family and place is not None and found[7] is None))
    if "unsupported" in (c_family, of_family, of_place):
        t = "not-measured"
    elif kind == "not-established":
        t = "unresolved"
    elif kind == "invalid":
        t = "invalid-accepted" if hit else "invalid-correct"
        if whole and not hit and (lacks or {c_family, of_family, of_place} != {"supported"}):
            t = "not-measured"
    elif not hit:
        t = "miss"
    elif hit[6] is None:
        t = "not-measured"
    elif hit[6] != family:
        t = "wrong-jurisdiction" if place and hit[7] and hit[7] != place else "wrong-family"
    elif place and hit[7] is None:
        t = "not-measured"
    else:
        t = "wrong-jurisdiction" if place and hit[7] != place else "correct"
    flag = hit[8] if hit else False if c_mood == "supported" else None
    if c_mood == "unsupported":
        m = "not-measured"
    elif mood in ("not-established", "context-dependent"):
        m = "unresolved"
    elif flag is None:
        m = "not-measured"
    else:
        m = "correct" if flag == (mood == "sensitive") else "false-positive" if flag else "miss"
    if m == "correct" and lacks and mood == "non-sensitive":
        m = "not-measured"
    r = "not-applicable" if whole else "unresolved" if start is None else "exact" if hit else "miss"
    a = "not-measured" if whole or start is None or c_action == "unavailable" else "reported" if hit and hit[9] else "no-action-reported"
    return t, m, r, a, hit[9] if a == "reported" else None


def test_every_cell(spark):
    authored = [(k, m, False, 2) for k, m in product(("valid", "invalid", "not-established"), ("sensitive", "non-sensitive", "not-established", "context-dependent"))]
    authored += [("not-established", "not-established", False, None), ("not-established", "context-dependent", False, None), ("invalid", "non-sensitive", True, None), ("invalid", "not-established", True, None)]
    reports = [None, *product((None, "email", "card"), (None, "US", "GB"), (None, True, False), (None, "redact"))]
    cells = [(*a, p, f) for a in authored for p in (None, "US") for f in reports]
    expectations = [(i, i, 0, "m", "en", p, "email", "neutral", whole, at, at and at + 4, k, m) for i, (k, m, whole, at, p, _) in enumerate(cells)]
    some = [{}, {"email": "supported"}, {"email": "unsupported"}]
    scanners = [(0, "complete", *c, "reported", fam, {"US": "supported"}) for c in [("supported", f, "supported", m) for f in CAPS for m in CAPS] for fam in some]
    scanners += [(0, "complete", "supported", "supported", j, "supported", "reported", {"email": "supported"}, p) for j in CAPS for p in ({}, {"US": "unsupported"}, {"GB": "supported"})]
    scanners += [(0, "complete", "supported", "supported", "supported", "supported", "unavailable", {"email": "supported"}, {}), (0, "complete", *["unsupported"] * 4, "reported", {}, {}), (0, "error", *["supported"] * 4, "reported", {}, {})]
    scanners = [(i, *s[1:]) for i, s in enumerate(scanners)]
    findings = [(s[0], i, i, 0, 2, 6, *c[-1]) for s in scanners for i, c in enumerate(cells) if c[-1]]
    rows = matching.assess(spark.createDataFrame(expectations, E), spark.createDataFrame(scanners, S), spark.createDataFrame(findings, F_)).persist()
    got = {(r.scanner_id, r.variant_id): (r.type_state, r.sensitivity_state, r.range_state, r.action_state, r.action) for r in rows.collect()}
    want = {(s[0], i): plain(e, s, c[-1] and (s[0], i, i, 0, 2, 6, *c[-1])) for s in scanners for i, (e, c) in enumerate(zip(expectations, cells))}
    assert got == want and len({w[0] for w in want.values()}) == 8
    assert verify.lattice(rows).where("cap_jurisdiction <> 'unsupported'").count() == 0
    broken = {
        "range-contradiction": ("range_state", "unresolved", "exp_start is not null"),
        "unreachable-type": ("type_state", "miss", "type_expectation = 'invalid'"),
        "unreachable-sensitivity": ("sensitivity_state", "miss", "sensitivity = 'non-sensitive'"),
        "measured-by-incomplete-scanner": ("type_state", "miss", "status = 'error' and type_expectation = 'valid'"),
        "measured-unsupported-type": ("type_state", "correct", "family_state = 'unsupported' and type_expectation = 'valid' and status = 'complete'"),
        "capability-contradiction": ("action_state", "no-action-reported", "cap_action = 'unavailable'"),
    }
    for code, (axis, value, where) in broken.items():
        bad = verify.lattice(rows.where(where).withColumn(axis, F.lit(value)))
        assert {r.code for r in bad.where("cap_jurisdiction <> 'unsupported'").collect()} == {code}


def test_findings_are_gone_through_once_for_all_scanners(spark):
    """The findings of a case were copied and filtered again for each scanner."""
    import __spark_entry__ as entry

    plan = entry.queries()["public_outcomes"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    above, crossing, below = plan.partition("Join")
    assert crossing and "lambda" not in above and "lambda" in below
