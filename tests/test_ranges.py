import re

import __spark_entry__ as entry
from tallyspan.functions import ranges

FOLDER = "/root/testdata/sf0.01"


def test_every_match_has_its_bytes(spark):
    texts = ["é 123 한 4567😀890", "123", "12 x", "", None, "111222 111 x 111"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sorted((r.doc_id, r.start, r.end_, r.token) for r in ranges.every_match(rows, "text", "[0-9]{3,}").collect())
    want = [(i, len(t[: m.start()].encode()), len(t[: m.end()].encode()), m[0]) for i, t in enumerate(texts) for m in re.finditer("[0-9]{3,}", t or "")]
    assert got == want


def test_range_defects_equal_brute_force(spark):
    got = {r.doc_id: r.defect for r in entry.queries()["range_validation"](spark, FOLDER).collect()}
    want = {}
    for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect():
        raw, s, e = r.text.encode(), r.doc_id % 50, r.doc_id % 37 + 10
        cuts = any(at < len(raw) and raw[at] & 192 == 128 for at in (s, e))
        defect = "inverted" if s > e else "empty" if s == e else "out-of-bounds" if e > len(raw) else "not-a-boundary" if cuts else None
        want |= {r.doc_id: defect} if defect else {}
    assert got == want and "not-a-boundary" in got.values()


def test_closeness_states_each_test_once(spark):
    """F14, F16, F17: the relation of both ranges used to stand in it five times, and was worked out as often for every finding."""
    from itertools import product

    from pyspark.sql import functions as F

    ends = [*range(4), None]
    rows = spark.createDataFrame([(a, b, c, d) for a, b in product(ends, ends) for c, d in product(ends, ends)], "e0 long, e1 long, f0 long, f1 long")
    columns = [F.col(c) for c in ("e0", "e1", "f0", "f1")]
    rank, tight = ranges.closeness(*columns)
    kind = ranges.relation(*columns)
    shared = F.least("e1", "f1") - F.greatest("e0", "f0")
    plain = F.when(kind == "exact", 0).when(kind == "overbroad", 1).otherwise(2), F.when(kind == "exact", 0).when(kind == "overbroad", F.expr("(f1 - f0) - (e1 - e0)")).otherwise(F.expr("e1 - e0") - shared)
    assert rows.where(~rank.eqNullSafe(plain[0]) | ~tight.eqNullSafe(plain[1])).count() == 0
    plan = rows.select(rank.alias("rank"), tight.alias("tight"))._jdf.queryExecution().analyzed().toString()
    assert plan.split("Project", 1)[1].split("\n")[0].count("<=") == 2
