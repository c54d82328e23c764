"""Variants of authored cases: byte ranges spliced in texts, and the drafts of all seven methods assembled with slots, ids, seeds and digests.

Each case is one row, and its drafts are an array that is exploded; nothing is shuffled. A case gives all its variants or one reason why it gives none.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import identity
from . import generate

#: How frames pair with expectations, the marker in their templates, and operators with their version.
PAIRED = {"sensitive": "sensitive", "neutral": "not-established", "non-sensitive": "non-sensitive"}
MARKER, MUTATION, FRAME, HOLD = "{{candidate}}", ("invalidate-final-digit", 1), ("context-frame", 1), ("review-hold", 1)
OBLIGED = "required-for-sensitive-classification"


class Rules(NamedTuple):
    """What ids and seeds are derived with, and limits."""

    generator: str
    version: int
    domain: str
    seed_rule: str = "pii-seed-v1"
    most_variants: int = 64
    most_bytes: int = generate.MAX_TEXT_BYTES


def spliced(text: Column, start: Column, end: Column, value: Column) -> Column:
    """The text with the bytes of a range replaced; null unless the range lies in it between whole characters."""
    raw = F.encode(text, "UTF-8")
    part = lambda at, n: F.substring(raw, (at + 1).cast("int"), n.cast("int"))
    whole = F.concat(part(F.lit(0), start), F.encode(value, "UTF-8"), part(end, F.octet_length(text) - end))
    return F.when((start >= 0) & (start <= end) & (end <= F.octet_length(text)), F.try_validate_utf8(whole.cast("string")))


def splice(texts: DataFrame, edits: DataFrame, key: str) -> DataFrame:
    """texts (key, text, ...) with all edits (key, start, end, value) of a text made at once.

    Edits of a text are bounded by it; they mustn't overlap, else its text is null. An edit outside the text or inside a character gives null, too.
    """
    per = edits.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("start", "end", "value"))).alias("edits"))
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").cast("binary").alias("out"), F.lit(True).alias("good"))
    raw = F.encode("text", "UTF-8")
    cut = lambda a, b: F.substring(raw, (a + 1).cast("int"), F.greatest(b - a, F.lit(0)).cast("int"))

    def step(acc: Column, e: Column) -> Column:
        good = acc["good"] & (e["start"] >= acc["at"]) & (e["start"] <= e["end"]) & (e["end"] <= F.octet_length("text"))
        return F.struct(e["end"].cast("long").alias("at"), F.concat(acc["out"], cut(acc["at"], e["start"]), F.encode(e["value"], "UTF-8")).alias("out"), F.coalesce(good, F.lit(False)).alias("good"))

    end = lambda acc: F.when(acc["good"], F.try_validate_utf8(F.concat(acc["out"], cut(acc["at"], F.octet_length("text"))).cast("string")))
    rows = texts.join(per, key, "left")
    return rows.withColumn("text", F.when(F.col("edits").isNull(), F.col("text")).otherwise(F.aggregate("edits", zero, step, end))).select(*texts.columns)


def shifted(ranges: DataFrame, edits: DataFrame, key: str) -> DataFrame:
    """ranges (key, s, e, ...) after the edits of their text: later ones move, one that an edit replaces exactly takes its new length.

    A range that an edit otherwise touches is null. Insertions at a range's start move it, at its end they don't.
    """
    size = (F.octet_length("value") - (F.col("end") - F.col("start"))).cast("long")
    per = edits.groupBy(key).agg(F.collect_list(F.struct("start", "end", size.alias("more"))).alias("edits"))
    s, e, none = F.col("s"), F.col("e"), F.lit(0).cast("long")
    zero = F.struct(none.alias("move"), none.alias("grow"), F.lit(False).alias("torn"))

    def step(acc: Column, x: Column) -> Column:
        exact = (x["start"] == s) & (x["end"] == e) & (s < e)
        move = F.when(~exact & (x["end"] <= s), x["more"]).otherwise(0)
        torn = acc["torn"] | (~exact & (x["start"] < e) & (s < x["end"]))
        return F.struct((acc["move"] + move).alias("move"), (acc["grow"] + F.when(exact, x["more"]).otherwise(0)).alias("grow"), torn.alias("torn"))

    rows = ranges.join(per, key, "left")
    rows = rows.withColumn("told", F.when(F.col("edits").isNull(), zero).otherwise(F.aggregate("edits", zero, step)))
    told = F.col("told")
    moved = {"s": F.when(~told["torn"], s + told["move"]), "e": F.when(~told["torn"], e + told["move"] + told["grow"])}
    return rows.select(*[moved[c].alias(c) if c in moved else F.col(c) for c in ranges.columns])


def _draft(slot: Column, text: Column, start: Column, end: Column, kind: Column, mood: Column, context: Column, strategy: Column, operator: tuple[str, int] | None, review: Column) -> Column:
    name, version = (F.lit(operator[0]), F.lit(operator[1])) if operator else (F.lit(None).cast("string"), F.lit(None).cast("int"))
    held = strategy == "review-required"
    name, version = F.when(held, HOLD[0]).otherwise(name), F.when(held, HOLD[1]).otherwise(version)
    cols = {"slot": slot, "text": text, "start": start.cast("long"), "end": end.cast("long"), "type_expectation": kind, "sensitivity": mood, "context_class": context, "strategy": strategy, "operator": name, "operator_version": version, "review": review}
    return F.struct(*[c.alias(n) for n, c in cols.items()])


def _frames(most: int) -> tuple[Column, Column]:
    """Why frames are refused, or null, and their drafts."""
    frames, none = F.col("frames"), F.lit(None).cast("string")
    value = F.col("value")
    parts = lambda f: F.split(f["template"], MARKER.replace("{", "\\{").replace("}", "\\}"), -1)
    paired = lambda f: F.coalesce(*[F.when(f["context_class"] == c, f["sensitivity"] == m) for c, m in PAIRED.items()], F.lit(False))
    fault = lambda f: F.when(~paired(f), "frame-expectation-mismatch").when(F.size(parts(f)) != 2, "frame-template-invalid").when(~F.regexp_like(f["id"], F.lit(identity.SHAPES["slug"])), "slot-invalid")
    faults = F.filter(F.transform(frames, fault), lambda x: x.isNotNull())
    classes = F.array_sort(F.array_distinct(F.transform(frames, lambda f: f["context_class"])))
    ids = F.transform(frames, lambda f: f["id"])
    reason = (
        F.when((F.col("type_expectation") != "valid") | ~F.col("obligation").eqNullSafe(OBLIGED), "context-case-invalid")
        .when(F.size(frames) > most, "too-many-variants")
        .when(~F.coalesce(classes == F.array(*map(F.lit, sorted(PAIRED))), F.lit(False)), "context-frames-not-a-trio")
        .when(F.size(faults) > 0, F.get(faults, F.lit(0)))
        .when(F.size(F.array_distinct(ids)) < F.size(ids), "duplicate-frame")
    )

    def draft(f: Column) -> Column:
        start = F.octet_length(parts(f)[0])
        return _draft(f["id"], F.replace(f["template"], F.lit(MARKER), value), start, start + F.octet_length(value), F.col("type_expectation"), f["sensitivity"], f["context_class"], F.lit("derived"), FRAME, none)

    return reason, F.transform(frames, draft)


def assembled(cases: DataFrame, rules: Rules) -> DataFrame:
    """(case_id, method, reason, slot, variant_id, text, start, end, type_expectation, sensitivity, context_class, strategy, operator, operator_version, seed, text_digest, parent_digest, review).

    One row for each variant of a case that none of its guards refuses, and one with the reason alone for each that is refused. cases has what
    ``generate.refusal`` reads, and case_id, case_seed, type_expectation, obligation, frames (id, template, context_class, sensitivity; context
    discrimination), mutation (id, version; mutation), validator and version (type validation, reference differential). An unavailable validator or
    reference leaves the variant to review; a reference that disagrees is recorded and changes nothing.
    """
    none, start, end, kind, mood = F.lit(None).cast("string"), F.col("exp_start"), F.col("exp_end"), F.col("type_expectation"), F.col("sensitivity")
    method, text = F.col("method"), F.col("text")
    value = F.decode(F.substring(F.encode("text", "UTF-8"), (start + 1).cast("int"), (end - start).cast("int")), "UTF-8")
    rows = cases.withColumn("guard", generate.refusal(rules.most_bytes)).withColumn("value", F.when(F.col("guard").isNull(), value))
    state = F.when(F.col("validator").isNotNull(), identity.observe(F.col("validator"), F.col("version"), F.col("value")))
    rows = rows.withColumn("observed", state)
    told, gone = F.col("observed"), F.coalesce(F.col("observed") == "unavailable", F.lit(False))
    differs = F.coalesce(kind.isin("valid", "invalid") & ~gone & (told != kind), F.lit(False))
    digit = F.regexp_like(F.col("value"), F.lit("[0-9]$"))
    op = F.col("mutation")
    mutation = F.when(~op["id"].eqNullSafe(MUTATION[0]), "operator-unknown").when(op["version"] != MUTATION[1], "operator-version-mismatch").when(~digit, "operator-not-applicable")
    frame_reason, frame_drafts = _frames(rules.most_variants)
    reason = (
        F.when(method == "type-validation", F.when(told.isNull(), "missing-validator").when(differs, "validator-expectation-mismatch"))
        .when(method == "reference-differential", F.when(told.isNull(), "missing-reference"))
        .when(method == "mutation", mutation)
        .when(method == "context-discrimination", frame_reason)
        .when(method == "pii-benign", F.when(~F.regexp_like("benign_class", F.lit(identity.SHAPES["slug"])), "slot-invalid"))
    )
    hold = F.when(gone, "review-required").otherwise("authored")
    review = F.when(gone, F.when(method == "reference-differential", "reference-unavailable").otherwise("validator-unavailable")).when((method == "reference-differential") & differs, "reference-disagrees")
    neutral, plain = F.lit("neutral"), F.lit("authored")
    last = F.substring("value", -1, 1).try_cast("int")
    mutated = spliced(text, end - 1, end, ((last + 1) % 10).cast("string"))
    changed = F.when(kind == "not-established", kind).otherwise("invalid")
    own = lambda slot, strategy=plain, review=none: F.array(_draft(slot, text, start, end, kind, mood, neutral, strategy, None, review))
    drafts = (
        F.when(method == "context-discrimination", frame_drafts)
        .when(method == "mutation", F.array(_draft(F.lit("mutated"), mutated, start, end, changed, mood, neutral, F.lit("derived"), MUTATION, none)))
        .when(method == "pii-benign", own(F.col("benign_class")))
        .when(method == "jurisdiction-collision", own(F.lit("collision")))
        .when(method == "type-validation", own(F.lit("validated"), hold, review))
        .when(method == "reference-differential", own(F.lit("reference"), hold, review))
        .otherwise(own(F.lit("authored")))
    )
    rows = rows.withColumn("reason", F.coalesce("guard", reason)).withColumn("drafts", drafts)
    large = F.exists("drafts", lambda d: F.octet_length(d["text"]) > rules.most_bytes)
    rows = rows.withColumn("reason", F.coalesce("reason", F.when(large, "text-too-large")))
    rows = rows.select("case_id", "case_seed", "method", "reason", F.when(F.col("reason").isNull(), F.sha2(F.encode("text", "UTF-8"), 256)).alias("parent_digest"), F.explode_outer(F.when(F.col("reason").isNull(), F.col("drafts"))).alias("d"))
    rows = rows.select("case_id", "case_seed", "method", "reason", "parent_digest", "d.*")
    given = F.col("slot").isNotNull()
    seed = identity.variant_seed(F.lit(rules.seed_rule), rules.domain, F.lit(rules.generator), F.lit(rules.version), F.col("case_seed"), F.col("case_id"), F.col("slot"))
    rows = rows.withColumn("variant_id", F.when(given, identity.variant_id(F.col("case_id"), F.col("slot")))).withColumn("seed", F.when(F.col("strategy") == "derived", seed)).withColumn("text_digest", F.sha2(F.encode("text", "UTF-8"), 256))
    return rows.select("case_id", "method", "reason", "slot", "variant_id", "text", "start", "end", "type_expectation", "sensitivity", "context_class", "strategy", "operator", "operator_version", "seed", "text_digest", "parent_digest", "review")
