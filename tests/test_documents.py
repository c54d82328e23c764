import hashlib
import json
import random
import statistics

import pytest
from pyspark.sql import functions as F

from tallyspan.functions import records
from tallyspan.operators import bindings, compare, legacy, normalize
from tallyspan.sources import documents


def test_canonical_json_is_what_a_sorted_dump_gives(spark):
    rows = [(1, 'a"b\\c', [1, -2], (True, "é\n\x1f")), (2, "", [], (False, "\U0001f600"))]
    df = spark.createDataFrame(rows, "z long, name string, list array<long>, inner struct<yes:boolean,a:string>")
    df = df.select("z", records.canonical(F.struct(*df.columns), df.schema).alias("text"))
    for z, name, numbers, (yes, a) in rows:
        want = json.dumps({"z": z, "name": name, "list": numbers, "inner": {"yes": yes, "a": a}}, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
        got = df.where(F.col("z") == z).first()["text"]
        assert got == want.replace("\\n", "\\u000a") and json.loads(got) == json.loads(want)


def test_canonical_json_has_no_nulls_nor_unsafe_integers(spark):
    rows = [(2**53, ["a"]), (2**53 - 1, ["a", None]), (None, []), (2**53 - 1, [])]
    df = spark.createDataFrame(rows, "n long, tags array<string>")
    got = [r[0] for r in df.select(records.canonical(F.struct("n", "tags"), df.schema)).collect()]
    assert got == [None, None, None, '{"n":9007199254740991,"tags":[]}']
    with pytest.raises(TypeError):
        records.canonical(F.lit(1.5), spark.range(1).select(F.lit(1.5).alias("x")).schema[0].dataType)


def test_timestamps_in_another_time_zone(spark):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        millis = [0, 951782399999, 1709164800000, 1710054000000, -5, 253402300800000]
        df = spark.createDataFrame([(m,) for m in millis], "m long").select("m", records.civil_timestamp(F.col("m")).alias("t"))
        got = {r["m"]: (r["t"], r["back"]) for r in df.withColumn("back", records.unix_millis(F.col("t"))).collect()}
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert got[951782399999] == ("2000-02-28T23:59:59.999Z", 951782399999)
    assert got[1709164800000] == ("2024-02-29T00:00:00.000Z", 1709164800000)
    assert got[1710054000000] == ("2024-03-10T07:00:00.000Z", 1710054000000)
    assert got[-5] == got[253402300800000] == got[0] == ("1970-01-01T00:00:00.000Z", 0)
    odd = spark.createDataFrame([("2024-01-01T00:00:00Z\n",), ("2024-13-01T00:00:00Z",), ("2024-01-01 00:00:00Z",), (None,)], "t string")
    assert [r[0] for r in odd.select(records.unix_millis(F.col("t"))).collect()] == [None] * 4


def test_commands(spark):
    bodies = ["/m run", "/m run a-1\r\nrest", "/m run\r", "/m run ", "/m  run", "", "> /m run", "/m run " + "a" * 40, "/m run " + "a" * 41, "/mx", None]
    rows = spark.createDataFrame([(i, b) for i, b in enumerate(bodies)], "i int, b string").select("i", records.command(F.col("b"), "/m").alias("x")).collect()
    got = {r["i"]: r["x"] and (r["x"]["kind"], r["x"]["profile"]) for r in rows}
    none, bad = ("not-a-command", None), ("malformed", None)
    assert [got[i] for i in range(len(bodies))] == [("run", None), ("run", "a-1"), bad, bad, bad, none, none, ("run", "a" * 40), bad, bad, None]


def test_medians_are_exact_also_for_few_many_and_equal_values(spark):
    values = {"one": [4.0], "two": [1.0, 2.0], "same": [7.0] * 50, "odd": [float(i * i % 1009) for i in range(2001)], "even": [float(i * 37 % 997) - 500 for i in range(2000)], "none": [None]}
    df = spark.createDataFrame([(k, v) for k, vs in values.items() for v in vs], "k string, v double")
    got = {r["k"]: (r["n"], r["median"]) for r in compare.medians(df, "k", "v").collect()}
    assert got == {k: (len(vs), statistics.median(vs)) for k, vs in values.items() if k != "none"}
    assert compare.medians(df.where("false"), "k", "v").count() == 0


def test_json_lines_and_rosters_are_read_from_files(spark, tmp_path):
    lines = ['{"id":"a"}', '{"id":"b","more":1}', "", '{"id":"b"}', '{"id":"a"}', "{broken", '{"id":"c"}']
    (tmp_path / "x.jsonl").write_text("\n".join(lines) + "\n")
    rows = documents.json_lines(spark, str(tmp_path / "x.jsonl"), "id string").orderBy("block", "line_at").collect()
    assert [r["code"] for r in rows] == [None, None, "record-invalid", "id-order-invalid", "id-order-invalid", "record-invalid", None]
    assert [r["line_sha256"] for r in rows] == [hashlib.sha256(x.encode()).hexdigest() for x in lines]
    roster = {"required": ["core"], "views": [{"view": "core", "cases": ["c1", "c2"]}, {"view": "more", "cases": []}], "controls": [{"class": "decoy", "cases": ["c2"]}]}
    (tmp_path / "roster.json").write_text(json.dumps(roster, indent=1))
    required, views, classes = documents.roster(spark, str(tmp_path / "roster.json"))
    assert [tuple(r) for r in required.collect()] == [("core",)]
    assert sorted(tuple(r) for r in views.collect()) == [("c1", "core"), ("c2", "core")]
    assert [tuple(r) for r in classes.select("case_id", "control_class").collect()] == [("c2", "decoy")]


@pytest.mark.parametrize("size", ["16", "100", "1m"])
def test_order_of_lines_across_splits(spark, tmp_path, size):
    r = random.Random(2)
    want = {}
    for name in ("x", "y"):
        ids = sorted(r.sample(range(10**6), 80))
        for k in (7, 30, 31, 55):
            ids[k] = ids[k - 1] - r.choice([0, 3])
        lines = [r.choice(["", "{bad", '{"other":1}']) if r.random() < 0.1 else json.dumps({"id": f"{i:08}", "pad": "é" * r.randrange(9)}, ensure_ascii=False) for i in ids]
        (tmp_path / f"{name}.jsonl").write_text("\n".join(lines) + "\n")
        before, codes = None, []
        for line in lines:
            here = json.loads(line).get("id") if line and line != "{bad" else None
            codes.append("record-invalid" if here is None else "id-order-invalid" if before is not None and before >= here else None)
            before = here or before
        want[name] = list(zip(lines, codes))
    key = "spark.sql.files.maxPartitionBytes"
    try:
        spark.conf.set(key, size)
        rows = documents.json_lines(spark, str(tmp_path / "*.jsonl"), "id string").collect()
    finally:
        spark.conf.unset(key)
    for name, lines in want.items():
        own = sorted((r for r in rows if r["file"].endswith(f"{name}.jsonl")), key=lambda r: (r["block"], r["line_at"]))
        assert [(r["value"], r["code"]) for r in own] == lines
    assert len({(r["file"], r["block"]) for r in rows}) > (2 if size == "1m" else 20) or size == "1m"


def test_pairing_by_id_of_single_scanners_and_of_none(spark):
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "scanner_id long")
    pairs = lambda a, b: sorted(tuple(r) for r in bindings.pairing(a, b).collect())
    assert pairs(ids(1, 2), ids(2, 1)) == [(1, 1, "by-id"), (2, 2, "by-id")]
    assert pairs(ids(1), ids(9)) == [(1, 9, "single-scanner")]
    assert pairs(ids(1, 2), ids(2)) == [(2, 2, "by-id-intersection")]
    assert pairs(ids(1, 2), ids(3)) == []


def test_rows_of_a_protected_run_are_not_published(spark):
    rows = spark.range(1).select(*[F.lit("x").alias(c) for c in bindings.PUBLIC], F.lit("secret").alias("families"))
    assert bindings.published_rows(rows, F.lit("public-synthetic")).columns == bindings.PUBLIC
    with pytest.raises(Exception, match="protected"):
        bindings.published_rows(rows, F.lit("protected")).collect()


def test_offsets_in_utf16_units_become_bytes(spark):
    text = "a\U0001f600é"
    native = [(0, 1, 0, "w", 1, 3), (0, 2, 0, "w", 1, 2), (0, 3, 0, "w", 3, 4), (0, 4, 0, "w", 0, 1)]
    native = spark.createDataFrame(native, "scanner_id long, variant_id long, position long, label string, start long, end_ long")
    texts = spark.createDataFrame([(1, text), (2, text), (3, text), (4, None)], "variant_id long, text string")
    words = spark.createDataFrame([(0, "w", "finding", None, None)], "scanner_id long, label string, verdict string, family string, jurisdiction string")
    scanners = spark.createDataFrame([(0, [], [])], "scanner_id long, families array<string>, jurisdictions array<string>")
    rows = normalize.mapped(native, texts, words, scanners, "utf16", 10)
    assert sorted((r["variant_id"], r["f_start"], r["f_end"]) for r in normalize.findings(rows).collect()) == [(1, 1, 5), (3, 5, 7)]
    assert {r["variant_id"]: r["failure"] for r in normalize.summary(rows).collect()} == {1: None, 2: "invalid-range", 3: None, 4: "invalid-range"}


def _legacy_row(case, variant, method="mutation", type_expectation="valid", sensitivity="sensitive", kind="correct", mood="correct", extent="exact"):
    return (0, case, variant, 0, method, "neutral", None, type_expectation, sensitivity, kind, mood, extent)


def test_older_accounting_by_hand(spark):
    columns = "scanner_id long, case_id long, variant_id long, occurrence_id long, method string, context_class string, jurisdiction string, type_expectation string, sensitivity string, type_state string, sensitivity_state string, range_state string"
    rows = [
        _legacy_row(1, 1, type_expectation="invalid", kind="invalid-correct"),
        _legacy_row(1, 2, kind="miss", extent="miss"),
        _legacy_row(2, 1, method="pii-benign", sensitivity="non-sensitive"),
        _legacy_row(2, 2, method="pii-benign", sensitivity="non-sensitive", mood="false-positive"),
    ]
    got = {(r["switches"], r["metric"]): r for r in legacy.counts(spark.createDataFrame(rows, columns)).collect()}
    assert len(got) == 80
    tell = lambda s, m: tuple(got[s, m][c] for c in ("numerator", "measured", "not_applicable"))
    assert tell(0, "type-miss-rate") == (1, 2, 0) and tell(legacy.FIRST_ROW, "type-miss-rate") == (0, 1, 1)
    assert tell(0, "benign-suppression-rate") == (0, 1, 1) and tell(legacy.ANY_ROW, "benign-suppression-rate") == (1, 1, 1)
    assert tell(0, "range-collateral-rate") == (0, 1, 1)
    assert {s for (s, _), r in got.items() if r["refused"]} == {s for s in range(8) if s & legacy.DISTINCT_BENIGN}


def test_rows_of_one_key_spread_over_tasks(spark):
    """All rows of a key used to go to one task where they meet its median."""
    rows = spark.range(0, 1000, 1, 16).select(F.lit("a").alias("k"), F.col("id").cast("double").alias("v"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        met = compare._beside(rows, spark.createDataFrame([("a", 1.0)], "k string, median double"), "k")
        assert met.count() == 1000 and met.select(F.spark_partition_id()).distinct().count() > 1
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert [tuple(r) for r in compare.trials(rows, "k", "v").collect()] == [("a", 1000, 499.5, 250.0, 0.0, 999.0)]
