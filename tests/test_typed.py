"""Typed documents by hand: paths and codes."""

from tallyspan.operators import typed

SOUND = '{"schema":"observation","scannerId":"s-1","status":"complete","replays":2,"inputs":[{"variantId":"a","findings":[{"start":0,"end":5}]},{"variantId":"b","findings":[]}]}'


def found(spark, kind, *docs):
    rows = spark.createDataFrame(list(enumerate(docs)), "id long, document string")
    out = [set() for _ in docs]
    for r in typed.violations(rows, typed.FIELDS[kind]).collect():
        out[r.id].add((r.path, r.code))
    return out


def test_observations(spark):
    swap = lambda a, b: SOUND.replace(a, b)
    docs = [SOUND, "{bad", None, "[1]", "3", "{}", swap('"b"', '"a"'), swap('"a"', '"c"'), swap('"end":5', '"end":5.5,"x":[{"y":1}]'), swap('"end":5', '"end":9007199254740992'), swap("[]", '{"0":1}'), swap("[]", "[[1]]"), swap("2,", "2000,")]
    missing = {(k, "schema-violation") for k in ("schema", "scannerId", "status", "replays", "inputs")}
    first = "inputs[0].findings[0]"
    assert found(spark, "observation", *docs) == [
        set(), set(), set(), {("", "schema-violation")}, {("", "schema-violation")}, missing, {("inputs", "duplicate-identity")}, {("inputs", "non-canonical-order")},
        {(f"{first}.end", "schema-violation"), (f"{first}.x", "schema-violation")}, {(f"{first}.end", "limit-exceeded")}, {("inputs[1].findings", "schema-violation")}, {("inputs[1].findings[0]", "schema-violation")}, {("replays", "limit-exceeded")},
    ]


def test_artifacts_against_themselves(spark):
    doc = '{"schema":"artifact","scanners":[{"id":"a","status":"complete"},{"id":"b","status":"error"}],"failures":[%s],"methodCoverage":[{"method":"m","cases":1,"variants":2}],"populationCounts":{"authoredCases":1,"variants":%d,"occurrences":%d}}'
    b, z = '{"scannerId":"b","code":"timeout"}', '{"scannerId":"z","code":"timeout"}'
    docs = [doc % (b, 2, 2), doc % ("", 2, 2), doc % (b + "," + z, 2, 2), doc % (b, 3, 3), doc % (b, 2, 1)]
    rows = spark.createDataFrame(list(enumerate(docs)), "id long, document string")
    assert found(spark, "artifact", *docs) == [set()] * 5
    got = sorted(tuple(r) for r in typed.artifact_defects(rows).collect())
    assert got == [(1, "failures", "status-inconsistent"), (2, "failures[1]", "unknown-scanner"), (3, "populationCounts", "count-mismatch"), (4, "populationCounts", "count-mismatch")]


def test_a_document_is_read_once_whatever_the_depth_of_its_table(spark):
    """Each level used to be another branch of a union, with the levels above it computed again."""
    rows = spark.createDataFrame([(1, SOUND.replace('"end":5', '"end":5.0')), (2, SOUND.replace('"end":5', '"end":-0')), (3, SOUND + " 4"), (4, SOUND.replace("2,", "2,2,"))], "id long, document string")
    rows = typed.violations(rows, typed.FIELDS["observation"])
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") + plan.count("LocalRelation") == 1
    assert [tuple(r) for r in rows.collect()] == [(1, "inputs[0].findings[0].end", "schema-violation")]


def test_documents_are_parsed_after_they_are_dealt(spark):
    """a filter used to move below the shuffle, so the one task that read the keys made and parsed every document."""
    from tallyspan.plans import exchanges

    plan = exchanges.typed_observations(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    at = plan.index("RepartitionByExpression")
    made, dealt = plan[:at], plan[at:]
    assert "concat(" in made and "concat(" not in dealt


def test_names_that_look_like_paths_are_unknown(spark):
    """names used to be joined to paths before they were looked up, so these passed as fields that lie elsewhere."""
    docs = [SOUND.replace("{", '{"inputs[]":{"variantId":"a","findings":[]},', 1), SOUND.replace("{", '{"":{},', 1), SOUND.replace("{", '{"inputs[].variantId":"a",', 1)]
    assert found(spark, "observation", *docs) == [{("inputs[]", "schema-violation")}, {("", "schema-violation")}, {("inputs[].variantId", "schema-violation")}]
