"""Digests of tables and the sink that verifies."""

import os

import pytest
from pyspark.sql import functions as F

from tallyspan.sources import staging


def digest(df):
    return tuple(staging.digest(df).first())


def test_digest_of_a_multiset(spark):
    rows = [(1, "a", None, 0.5), (2, "", True, 1.0), (2, "", True, 1.0), (3, None, False, None)]
    df = spark.createDataFrame(rows, "i long, s string, b boolean, d double")
    same = digest(df)
    assert same[0] == 4 and len(same[1]) == 64
    assert digest(df.repartition(3).orderBy(F.desc("i"))) == same == digest(df.select("d", "b", "s", "i"))
    others = [df.distinct(), df.limit(3), df.withColumn("s", F.coalesce("s", F.lit(""))), df.withColumn("i", F.when(F.col("i") == 3, 4).otherwise(F.col("i"))), df.union(df.limit(1)), df.limit(0)]
    assert len({digest(o) for o in others} | {same}) == len(others) + 1
    swapped = [spark.createDataFrame(r, "a string, b string") for r in ([("x", "y"), ("z", "w")], [("x", "w"), ("z", "y")], [("=x", "y"), ("z", "w")])]
    assert len({digest(s) for s in swapped}) == 3


def test_publish(spark, tmp_path, monkeypatch):
    df = spark.range(100).withColumn("x", F.col("id") % 7)
    path = str(tmp_path / "table")
    first = staging.publish(df, path)
    assert first == digest(df)[1] == digest(spark.read.parquet(path))[1]
    with pytest.raises(FileExistsError):
        staging.publish(df.limit(5), path)
    second = staging.publish(df.limit(5), path, replace=True)
    assert second != first and spark.read.parquet(path).count() == 5
    assert staging.publish(df.limit(0), str(tmp_path / "none")) == digest(df.limit(0))[1]
    whole = staging.digest
    monkeypatch.setattr(staging, "digest", lambda t: whole(t.limit(3)))
    with pytest.raises(staging.NotVerified):
        staging.publish(df, path, replace=True)
    with pytest.raises(staging.NotVerified):
        staging.publish(df, str(tmp_path / "new"))
    assert spark.read.parquet(path).count() == 5 and sorted(os.listdir(tmp_path)) == ["none", "table"]


@pytest.mark.parametrize("length", [0, 1, 127, 128, 300])
def test_preimage_of_any_length(spark, length):
    """Short and long fields have their lengths written in different ways, and numbers count as their text."""
    from tallyspan.functions import identity

    text = "é" * (length // 2) + "x" * (length % 2)
    got = spark.createDataFrame([(text, 17)], "s string, i int").select(identity.preimage(F.col("s"), F.col("i")).alias("p")).first()["p"]
    assert bytes(got) == length.to_bytes(4, "big") + text.encode() + b"\0\0\0\x0217"


def test_digests_in_one_pass(spark):
    """Tables that share rows were worked out once for each of them."""
    df = spark.createDataFrame([(1, "both"), (1, "both"), (2, "old"), (3, "new")], "i long, tag string")
    runs = {"first": ("both", "old"), "second": ("both", "new"), "none": ("other",)}
    got = {r["run"]: (r["rows"], r["digest"]) for r in staging.digests(df, "tag", runs).collect()}
    assert got == {run: digest(df.where(F.col("tag").isin(*tags)).drop("tag")) for run, tags in runs.items()}


def test_replay_works_each_table_out_once(spark):
    """The first and the changed table were one assessment each, and a row's hash was converted once for each of its limbs."""
    import __spark_entry__ as entry

    plan = entry.queries()["replay_equality"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate explode(CASE WHEN") and len([x for x in plan.splitlines() if "Relation" in x and "lineitem" in x]) <= 1 and plan.count("conv(") <= 2 * 6
