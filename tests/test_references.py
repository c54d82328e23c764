import __spark_entry__ as entry
from tallyspan.operators import verify

FOLDER = "/root/testdata/sf0.001"


def test_a_dangling_finding_is_found(spark, tmp_path):
    orders, lines = (spark.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("orders", "lineitem"))
    gone = lines.select("l_orderkey").first()[0]
    orders.where(f"o_orderkey <> {gone}").write.parquet(str(tmp_path / "orders.parquet"))
    lines.write.parquet(str(tmp_path / "lineitem.parquet"))
    out = entry.queries()["reference_integrity"](spark, str(tmp_path)).collect()
    bad = [r for r in out if r.code == "finding-without-variant"]
    assert {r.case_id for r in bad} == {gone} and len(bad) == lines.where(f"l_orderkey = {gone}").count()
    silent = {r.o_orderkey for r in orders.collect()} - {r.l_orderkey for r in lines.collect()}
    assert {r.case_id for r in out if r.code == "case-without-finding"} == silent


def test_each_reference_that_leads_nowhere(spark):
    make = spark.createDataFrame
    tables = {t: make([(t[0],)], "id string") for t in ("sources", "kinds", "jurisdictions", "contexts", "events")}
    tables["claims"] = make([("c", "s"), ("d", "x1")], "id string, source string")
    case = "id string, kind string, jurisdiction string, contexts array<string>, sources array<string>, claims array<string>, related array<string>, events array<string>"
    tables["cases"] = make([("a", "k", "j", ["c"], ["s"], ["c"], ["b"], ["e"]), ("b", "x2", "x3", ["c", "x4"], ["x5"], ["d", "x6"], ["x7"], ["x8"])], case)
    tables["rules"] = make([("r", ["a", "x9"])], "id string, cases array<string>")
    tables["skips"] = make([("a/r", "a", "r"), ("y/z", "x10", "x11")], "id string, case string, rule string")
    got = sorted(r.target for r in verify.unresolved(tables).collect())
    assert got == sorted(f"x{i}" for i in range(1, 12))
