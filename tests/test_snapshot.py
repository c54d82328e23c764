"""Stages of a snapshot by hand."""

import hashlib

from tallyspan.operators import snapshot


def table(spark, schema, *rows):
    return spark.createDataFrame(list(rows), schema)


def rows(df):
    return sorted((r.snapshot, r.code, r.place) for r in df.collect())


def test_files_counts_and_safety(spark):
    files = "snapshot long, path string, bytes long, records long"
    listed = table(spark, files, (1, "a", 3, 1), (1, "b", 3, 1), (1, "c", 3, 1), (1, "d", 3, None))
    present = table(spark, files, (1, "a", 3, 1), (1, "b", 4, 1), (1, "d", 3, 2), (1, "e", 3, 1))
    assert rows(snapshot.file_defects(listed, present)) == [(1, "file-length-mismatch", "b"), (1, "file-missing", "c"), (1, "file-unlisted", "e")]
    held = table(spark, "snapshot long, id string", (1, "x"), (1, "y"), (2, "x"))
    counts = table(spark, "snapshot long, key string, n long", (1, "cases", 2), (2, "cases", 3), (3, "cases", 0), (3, "other", 9))
    assert rows(snapshot.count_defects(counts, {"cases": held})) == [(2, "count-mismatch", "cases")]
    assert rows(snapshot.count_defects(counts.limit(0), {"cases": held})) == [(1, "count-mismatch", "cases"), (2, "count-mismatch", "cases")]
    assert rows(snapshot.safety_defects(table(spark, "snapshot long, id string, origin string", (1, "a", "synthetic"), (1, "b", None), (1, "c", "web")))) == [(1, "source-not-public-safe", "b"), (1, "source-not-public-safe", "c")]


def test_references_stay_in_their_snapshot(spark):
    known = table(spark, "snapshot long, id string", (1, "k"), (2, "l"))
    refs = table(spark, "snapshot long, id string, to string, many array<string>", (1, "a", "k", ["k", "l"]), (2, "b", "k", []), (2, "c", None, None))
    assert rows(snapshot.reference_defects(refs, "id", refs["to"], known)) == [(2, "reference-unresolved", "b")]
    assert rows(snapshot.reference_defects(refs, "id", refs["many"], known)) == [(1, "reference-unresolved", "a")]
    pairs = "snapshot long, id string, case string, rule string"
    found = snapshot.pair_defects(table(spark, pairs, (1, "a/r", "a", "r"), (1, "b/x", "b", "r")), table(spark, pairs, (1, "a/r", "a", "r"), (2, "a/r", "a", "r")))
    assert rows(found) == [(1, "reference-unresolved", "a/r"), (1, "reference-unresolved", "b/x")]


def test_fixtures_agree_with_case_and_rule(spark):
    cases = table(spark, "snapshot long, id string, text string, start long, end long, identity string, sensitivity string, evidence_class string", (1, "c", "ab VALUE", 3, 8, "valid", "sensitive", "x"))
    rules = table(spark, "snapshot long, id string, version int, mode string", (1, "copy", 1, "copy"), (1, "derive", 1, "derived"))
    text = "> é VALUE"
    good = dict(snapshot=1, id="f", case="c", rule="copy", rule_version=1, evidence_class="x", content=text, byte_length=10, sha256=hashlib.sha256(text.encode()).hexdigest(), start=5, end=10, identity="valid", sensitivity="sensitive", derived=False)
    derived = good | dict(rule="derive", derived=True, identity="not-established", sensitivity="context-dependent", start=None, end=None)
    wanted = [
        (good, None), (derived, None), (good | dict(rule="gone"), None), (good | dict(rule_version=2), "reference-unresolved"), (good | dict(evidence_class="y"), "reference-unresolved"),
        (good | dict(byte_length=9), "fixture-length-mismatch"), (good | dict(sha256="0"), "fixture-digest-mismatch"), (good | dict(start=3), "span-invalid"), (good | dict(end=11), "span-invalid"), (good | dict(start=-1), "span-invalid"),
        (good | dict(end=9), "fixture-expectation-mismatch"), (good | dict(start=None, end=None), "fixture-expectation-mismatch"), (good | dict(derived=True), "fixture-expectation-mismatch"), (good | dict(sensitivity="x"), "fixture-expectation-mismatch"), (derived | dict(start=5, end=10), "fixture-expectation-mismatch"),
    ]
    schema = "snapshot long, id string, case string, rule string, rule_version int, evidence_class string, content string, byte_length long, sha256 string, start long, end long, identity string, sensitivity string, derived boolean"
    fixtures = [tuple((f | dict(id=f"{i:02}"))[c.split()[0]] for c in schema.split(", ")) for i, (f, _) in enumerate(wanted)]
    got = {p: c for _, c, p in rows(snapshot.fixture_defects(spark.createDataFrame(fixtures, schema), cases, rules))}
    assert got == {f"{i:02}": c for i, (_, c) in enumerate(wanted) if c}


def test_the_first_stage_decides(spark):
    d = "snapshot long, stage int, code string, place string"
    defects = [table(spark, d, (1, 4, "a", "p"), (1, 4, "b", "a")), table(spark, d, (1, 2, "z", "q"), (1, 2, "z", "b"), (2, 5, "f", "x"))]
    out = snapshot.first_failures(table(spark, "snapshot long", (1,), (2,), (3,)), defects)
    assert sorted(tuple(r) for r in out.collect()) == [(1, "counts", "z", "b", 2), (2, "fixtures", "f", "x", 1), (3, None, None, None, 0)]
