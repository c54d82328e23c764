"""Native findings as findings: labels by a scanner's vocabulary, offsets in bytes, and the inputs that fail."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import translate

INPUT = ["scanner_id", "variant_id"]


def mapped(native: DataFrame, texts: DataFrame, vocabulary: DataFrame, scanners: DataFrame, unit: str, most: int) -> DataFrame:
    """native with verdict, family, jurisdiction, f_start and f_end in bytes, code of the finding, and failure of its whole input.

    native: INPUT, position, label, start, end_ in ``unit`` (bytes, utf16 or points); texts: (variant_id, text). vocabulary: (scanner_id, label, verdict,
    family, jurisdiction) with the verdict skip or finding; scanners: (scanner_id, families, jurisdictions) that they declare. Both are bounded by
    what scanners declare, not by the findings, and joined as Spark sees fit. An input fails as a whole: with more findings than ``most``, then
    for a label that the vocabulary lacks, then for its first finding of an undeclared scope or without a range. Skipped
    findings need no range. Inputs are judged by one fold; those with more than ``most`` findings are not translated, so the
    findings of a text that meet it are bounded.
    """
    known = native.join(vocabulary, ["scanner_id", "label"], "left").join(scanners, "scanner_id", "left")
    sizes = native.groupBy(*INPUT).agg((F.count("*") > most).alias("crowded"))
    known = known.join(sizes, INPUT).withColumn("start", F.when(~F.col("crowded"), F.col("start")))
    rows = translate.to_bytes(known, texts, "variant_id", unit)
    undeclared = lambda c: F.col(c).isNotNull() & ~F.coalesce(F.array_contains(F.col({"family": "families", "jurisdiction": "jurisdictions"}[c]), F.col(c)), F.lit(False))
    finding = F.when(undeclared("family") | undeclared("jurisdiction"), "undeclared").when(~F.col("fits"), "invalid-range")
    code = F.when(F.col("verdict").isNull(), "unmapped-label").when(F.col("verdict") == "finding", finding)
    rows = rows.withColumn("code", code).drop("families", "jurisdictions", "fits")
    first = F.min_by("code", F.when(F.col("code").isin("undeclared", "invalid-range"), F.col("position")))
    failure = F.when(F.bool_or("crowded"), "output-limit").when(F.bool_or(F.col("code") == "unmapped-label"), "unmapped-label").otherwise(first)
    judged = rows.groupBy(*INPUT).agg(failure.alias("failure"))
    return rows.drop("crowded").join(judged, INPUT)


def findings(rows: DataFrame) -> DataFrame:
    """The findings of inputs that didn't fail, of ``mapped``."""
    return rows.where("failure is null and verdict = 'finding'").select(*INPUT, "position", "f_start", "f_end", "family", "jurisdiction")


def summary(rows: DataFrame) -> DataFrame:
    """(scanner_id, variant_id, failure, findings, skipped) of each input of ``mapped``; a failed input keeps neither."""
    kept = lambda verdict: F.count_if(F.col("failure").isNull() & (F.col("verdict") == verdict))
    return rows.groupBy(*INPUT).agg(F.min("failure").alias("failure"), kept("finding").alias("findings"), kept("skip").alias("skipped"))
