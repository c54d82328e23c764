"""Comparison of measurements, replays and trials."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def relations(base: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """How each metric of two measurements relates; never a ranking."""
    side = lambda df, s: df.select(*keys, F.struct("value_state", "point", "bound").alias(s))
    rows = side(base, "a").join(side(other, "b"), keys, "full")
    a, b = F.col("a"), F.col("b")
    held = lambda s: s["value_state"] != "published"
    kind = (
        F.when(a.isNull(), "absent-in-base")
        .when(b.isNull(), "absent-in-other")
        .when(held(a) & held(b), "withheld-in-both")
        .when(held(a), "withheld-in-base")
        .when(held(b), "withheld-in-other")
        .when(a["point"].eqNullSafe(b["point"]) & a["bound"].eqNullSafe(b["bound"]), "identical")
        .otherwise("changed")
    )
    return rows.select(*keys, kind.alias("relation"))


def changed_fields(base: DataFrame, other: DataFrame, fields: list[str], key: str) -> DataFrame:
    """(key, field, base, other) of the fields in which the rows of a key differ; a key that one side lacks has null there."""
    side = lambda df, name: df.select(key, F.struct(*[F.col(f).cast("string").alias(f) for f in fields]).alias(name))
    rows = side(base, "a").join(side(other, "b"), key, "full")
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"a.{f}").alias("base"), F.col(f"b.{f}").alias("other")) for f in fields])
    changed = F.filter(pairs, lambda x: ~x["base"].eqNullSafe(x["other"]))
    return rows.select(key, F.explode(changed).alias("x")).select(key, "x.*")


def _input(findings: DataFrame, name: str) -> DataFrame:
    cols = ["f_start", "f_end", "f_family", "f_jurisdiction", "f_sensitive", "f_action"]
    return findings.groupBy("scanner_id", "variant_id").agg(F.array_sort(F.collect_list(F.struct(*cols))).alias(name))


def stability(first: DataFrame, again: DataFrame) -> DataFrame:
    """(scanner_id, inputs, differing): inputs whose findings differ, as multisets, between two passes."""
    rows = _input(first, "a").join(_input(again, "b"), ["scanner_id", "variant_id"], "full")
    return rows.groupBy("scanner_id").agg(F.count("*").alias("inputs"), F.count_if(~F.col("a").eqNullSafe(F.col("b"))).alias("differing"))


def islands(rows: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """(key, s, e, n): ranges that touch or overlap, merged."""
    # a row's number breaks ties, so that both windows read one order, sorted once
    order = W.partitionBy(key).orderBy(start, end, "row")
    before = F.max(end).over(order.rowsBetween(W.unboundedPreceding, -1))
    marked = rows.select(key, start, end, F.monotonically_increasing_id().alias("row")).withColumn("fresh", F.when(F.col(start) <= before, 0).otherwise(1))
    grouped = marked.withColumn("island", F.sum("fresh").over(order.rowsBetween(W.unboundedPreceding, 0)))
    return grouped.groupBy(key, "island").agg(F.min(start).alias("s"), F.max(end).alias("e"), F.count("*").alias("n")).drop("island")


#: How finely a key's values are cut before their middle is looked for.
STEPS = 64
#: Parts into which a key's rows are dealt where they meet what is known of the key.
PARTS = 64


def _beside(rows: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """rows join known, which has one row a key. A key's rows meet copies of it in up to PARTS parts, by the partition that they come from, so that few keys don't mean few tasks."""
    copies = known.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(PARTS - 1).cast("long"))))
    return rows.withColumn("part", (F.spark_partition_id() % PARTS).cast("long")).join(copies, [key, "part"]).drop("part")


def medians(rows: DataFrame, key: str, value: str) -> DataFrame:
    """(key, n, median) of the values that aren't null, exact: the mean of the two in the middle.

    Values are counted, and cut at approximate quantiles; only the step or two that hold the middle are sorted, so no task sees a whole key.
    """
    held = rows.where(F.col(value).isNotNull()).select(key, F.col(value).cast("double").alias("x"))
    cuts = held.groupBy(key).agg(F.percentile_approx("x", [i / STEPS for i in range(1, STEPS)]).alias("cuts"), F.count("x").alias("n"))
    cells = _beside(held.groupBy(key, "x").agg(F.count("*").alias("m")), cuts, key)
    cells = cells.withColumn("step", F.size(F.filter("cuts", lambda c: c < F.col("x")))).drop("cuts")
    sums = cells.groupBy(key, "step").agg(F.sum("m").alias("held"), F.first("n").alias("n"))
    sums = sums.withColumn("upto", F.sum("held").over(W.partitionBy(key).orderBy("step").rowsBetween(W.unboundedPreceding, 0)))
    low, high = F.floor((F.col("n") + 1) / 2), F.floor((F.col("n") + 2) / 2)
    middle = sums.where((F.col("upto") >= low) & (F.col("upto") - F.col("held") < high)).select(key, "step", (F.col("upto") - F.col("held")).alias("before"))
    ranked = cells.join(middle, [key, "step"])
    rank = F.col("before") + F.sum("m").over(W.partitionBy(key, "step").orderBy("x").rowsBetween(W.unboundedPreceding, 0))
    at = lambda r: F.min(F.when(F.col("rank") >= r, F.col("x")))
    return ranked.withColumn("rank", rank).groupBy(key).agg(F.first("n").alias("n"), ((at(low) + at(high)) / 2).alias("median"))


def trials(rows: DataFrame, key: str, value: str) -> DataFrame:
    """(key, n, median, mad, least, most) of the keys that have a value, the median absolute deviation taken in a second pass."""
    mid = medians(rows, key, value)
    away = _beside(rows, mid.select(key, "median"), key).select(key, F.abs(F.col(value) - F.col("median")).alias("away"))
    ends = rows.where(F.col(value).isNotNull()).groupBy(key).agg(F.min(value).alias("least"), F.max(value).alias("most"))
    return mid.join(medians(away, key, "away").select(key, F.col("median").alias("mad")), key).join(ends, key)


def steepest(cells: DataFrame, key: str, x: str, y: str) -> DataFrame:
    """(key, slope): the largest slope of ln y over ln x between neighbours in order of x; null with fewer than two cells.

    cells has one row for each key and x, both sides above zero; cells without a value are passed over pair by pair.
    """
    order = W.partitionBy(key).orderBy(x)
    rise = F.log(F.col(y) / F.lag(y).over(order)) / F.log(F.col(x) / F.lag(x).over(order))
    return cells.withColumn("slope", rise).groupBy(key).agg(F.max("slope").alias("slope"))
