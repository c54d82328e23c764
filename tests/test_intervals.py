"""The binned interval join against all pairs, and its spread over tasks."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from tallyspan.operators import intervals, matching


@pytest.mark.parametrize("width", [1, 7, 1000])
def test_overlaps_equal_all_pairs(spark, width):
    r = random.Random(width)

    def side(n):
        out = [(i, r.choice(["a", "b", None]), s := r.randrange(60), s + r.choice([-1, 0, 1, 2, 9, 40])) for i in range(n)]
        return [*out, (n, "a", None, 5), (n + 1, "a", 5, None)]

    left, right = side(60), side(70)
    got = intervals.overlapping(spark.createDataFrame(left, "i int, k string, a int, b int"), spark.createDataFrame(right, "j int, k string, c int, d int"), "k", ("a", "b"), ("c", "d"), width)
    want = [(i, j) for i, k, a, b in left for j, m, c, d in right if k and k == m and None not in (a, b, c, d) and a < b and c < d and a < d and c < b]
    assert sorted((x.i, x.j) for x in got.collect()) == sorted(want)


def test_a_hot_variant_spreads_over_tasks(spark):
    """One variant holds a third of all findings: the largest task reads less than ten times the median."""
    spread = F.pmod(F.xxhash64("id"), F.lit(1_000_000))
    findings = spark.range(60_000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("variant_id"), spread.alias("f_start"), (spread + 12).alias("f_end"))
    hot = spark.range(20_000).select(F.lit(0).cast("long").alias("variant_id"), (F.col("id") * 50).alias("exp_start"), (F.col("id") * 50 + 9).alias("exp_end"))
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "32")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        pairs = intervals.overlapping(hot, findings, "variant_id", matching.EXPECTED, matching.REPORTED)
        rows = findings.withColumn("bin", F.explode(intervals.bins(F.col("f_start"), F.col("f_end")))).repartition("variant_id", "bin").groupBy(F.spark_partition_id().alias("p")).count().collect()
        sizes = [r["count"] for r in rows]
        assert max(sizes) < 10 * statistics.median(sizes) and len(sizes) == 32
        each = [r["count"] for r in pairs.groupBy(F.spark_partition_id().alias("p")).count().collect()]
        assert max(each) < 10 * statistics.median(each)
        plain = hot.join(findings, "variant_id").where("exp_start < f_end and f_start < exp_end")
        assert pairs.count() == plain.count()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_bins_do_not_change_outcomes(spark, monkeypatch):
    import __spark_entry__ as entry

    ask = lambda q: sorted(map(tuple, entry.queries()[q](spark, "/root/testdata/sf0.001").collect()), key=repr)
    names = ["outcome_matrix", "reported_spans", "overlap_candidates"]
    usual = [ask(q) for q in names]
    monkeypatch.setattr(intervals.overlapping, "__defaults__", (5,))
    assert [ask(q) for q in names] == usual


def test_islands_are_sorted_once(spark):
    """A second window in another order sorted all ranges again."""
    from tallyspan.operators import compare

    rows = [("a", 0, 5), ("a", 0, 5), ("a", 5, 9), ("a", 12, 14), ("a", 12, 12), ("b", 3, 4), ("b", 3, 4), ("c", 7, 7), ("c", 7, 7), ("c", 7, 9), ("d", 9, 3), ("d", 9, 3), ("d", 4, 6)]
    out = compare.islands(spark.createDataFrame(rows, "k string, x long, y long"), "k", "x", "y")
    got = sorted(tuple(r) for r in out.collect())
    assert got == [("a", 0, 9, 3), ("a", 12, 14, 2), ("b", 3, 4, 2), ("c", 7, 9, 3), ("d", 4, 6, 1), ("d", 9, 3, 1), ("d", 9, 3, 1)]
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        assert compare.islands(spark.createDataFrame(rows, "k string, x long, y long"), "k", "x", "y")._jdf.queryExecution().executedPlan().toString().count("Sort [k") == 1
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
