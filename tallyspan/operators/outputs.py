"""What a sanitized text still holds of the expected occurrences, and whether anything around them changed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import ranges

#: Limits of a text, a sanitized text and the occurrences of one variant.
MOST_TEXT, MOST_SANITIZED, MOST_OCCURRENCES = 1024 * 1024, 8 * 1024 * 1024, 16


def _merge(spans: Column, r: Column) -> Column:
    last = F.try_element_at(spans, F.lit(-1))
    joined = F.concat(F.slice(spans, 1, F.size(spans) - 1), F.array(F.struct(last["start"].alias("start"), F.greatest(last["end"], r["end"]).alias("end"))))
    return F.when((F.size(spans) > 0) & (r["start"] <= last["end"]), joined).otherwise(F.concat(spans, F.array(r)))


def _take(state: Column, segment: Column) -> Column:
    """Find the next segment leftmost in the rest; what lies before it replaces the span in front of it."""
    at = F.position(segment, state["rest"])
    return F.struct(
        (state["ok"] & (at > 0)).alias("ok"),
        F.substring(state["rest"], at + F.char_length(segment), F.char_length(state["rest"])).alias("rest"),
        F.concat(state["regions"], F.array(F.substring(state["rest"], F.lit(1), at - 1))).alias("regions"),
    )


def _bytes(raw: Column, start: Column, end: Column) -> Column:
    return F.substring(raw, (start + 1).cast("int"), (end - start).cast("int")).cast("string")


def verify_outputs(occurrences: DataFrame, texts: DataFrame, key: str) -> DataFrame:
    """(key, occurrence_id, refusal, context_preserved, verdict), one row per occurrence of a text in ``texts``.

    occurrences: (key, occurrence_id, start, end) in bytes; texts: (key, text, sanitized), one row per key. Ranges that touch
    or overlap are merged; the text between them must stand in the sanitized text in its order, each piece found leftmost. An
    occurrence is ``residual-present`` if its text is still in the region that replaced its span, or anywhere if the pieces
    weren't found; else ``collateral-change`` if they weren't found; else ``removed``. A key with a text or range out of
    bounds has a refusal, and no verdicts. A null sanitized text gives null in all three.

    One shuffle on the key brings occurrences and texts together; no group passes MOST_OCCURRENCES + 1 rows on to the
    array of its ranges, since a key with more is refused whatever they are.
    """
    order = W.partitionBy(key).orderBy("start", "end", "occurrence_id")
    held = occurrences.select(key, "occurrence_id", "start", "end").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= MOST_OCCURRENCES + 1)
    held = held.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end")))).alias("all"))
    text, raw = F.col("text"), F.encode("text", "UTF-8")
    rows = texts.select(key, "text", "sanitized").join(held, key)
    refusal = (
        F.when(F.octet_length(text) > MOST_TEXT, "text-too-large")
        .when(F.octet_length("sanitized") > MOST_SANITIZED, "output-too-large")
        .when(F.size("all") > MOST_OCCURRENCES, "too-many-occurrences")
        .when(F.exists("all", lambda r: ranges.range_error(text, r["start"], r["end"]).isNotNull()), "range")
    )
    rows = rows.withColumn("refusal", refusal)
    none = F.expr("cast(array() as array<struct<start: bigint, end: bigint>>)")
    rows = rows.withColumn("spans", F.when(F.col("refusal").isNull(), F.aggregate("all", none, _merge)))

    def segment(i: Column) -> Column:
        start = F.when(i == 0, F.lit(0).cast("long")).otherwise(F.try_element_at("spans", F.greatest(i, F.lit(1)))["end"])
        end = F.coalesce(F.try_element_at("spans", i + 1)["start"], F.octet_length(text).cast("long"))
        return _bytes(raw, start, end)

    rows = rows.withColumn("segments", F.transform(F.sequence(F.lit(0), F.size("spans")), segment))
    first, last, whole = F.element_at("segments", 1), F.element_at("segments", -1), F.col("sanitized")
    framed = F.startswith(whole, first) & F.endswith(whole, last) & (F.octet_length(first) + F.octet_length(last) <= F.octet_length(whole))
    body = F.substring(whole, F.char_length(first) + 1, F.char_length(whole) - F.char_length(first) - F.char_length(last))
    rows = rows.withColumn("body", F.when(framed, body))
    start = F.struct(F.col("body").isNotNull().alias("ok"), F.coalesce("body", F.lit("")).alias("rest"), F.expr("cast(array() as array<string>)").alias("regions"))
    rows = rows.withColumn("found", F.aggregate(F.slice("segments", 2, F.greatest(F.size("segments") - 2, F.lit(0))), start, _take))
    rows = rows.select(key, "text", "sanitized", "refusal", "spans", "found.ok", F.concat("found.regions", F.array("found.rest")).alias("regions"))

    rows = occurrences.select(key, "occurrence_id", "start", "end").join(rows, key)
    value = _bytes(raw, F.col("start"), F.col("end"))
    place = F.aggregate("spans", F.lit(0), lambda n, s: n + F.when(s["start"] <= F.col("start"), 1).otherwise(0))
    region = F.when(F.col("ok"), F.try_element_at("regions", place)).otherwise(F.col("sanitized"))
    verdict = F.when(F.contains(region, value), "residual-present").when(~F.col("ok"), "collateral-change").otherwise("removed")
    judged = F.col("refusal").isNull() & F.col("sanitized").isNotNull()
    return rows.select(key, "occurrence_id", "refusal", F.when(judged, F.col("ok")).alias("context_preserved"), F.when(judged, verdict).alias("verdict"))
