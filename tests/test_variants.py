"""Splicing against plain bytes, and assembled variants by hand."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tallyspan.operators import variants


def test_splices_and_shifts(spark):
    r = random.Random(6)
    texts, edits, spans, want, moved = [], [], [], {}, {}
    for k in range(40):
        text = "".join(r.choice("aé한😀 ") for _ in range(r.randrange(14)))
        raw = text.encode()
        cuts = sorted(r.sample(sorted({len(text[:i].encode()) for i in range(len(text) + 1)}), min(len(text) + 1, 4)))
        own = [(s, e, r.choice(["", "x", "日本", "long value"])) for s, e in zip(cuts[::2], cuts[1::2])]
        out = raw
        for s, e, v in reversed(own):
            out = out[:s] + v.encode() + out[e:]
        texts.append((k, text))
        edits += [(k, *x) for x in own]
        want[k] = out.decode()
        for n, (s, e) in enumerate((s, e) for s in range(len(raw) + 1) for e in range(s + 1, len(raw) + 1)):
            spans.append((k, n, s, e))
            hit = [x for x in own if x[0] < e and s < x[1] and x[:2] != (s, e)]
            by = sum(len(v.encode()) - (b - a) for a, b, v in own if b <= s)
            exact = sum(len(v.encode()) - (b - a) for a, b, v in own if (a, b) == (s, e))
            moved[k, n] = (None, None) if hit else (s + by, e + by + exact)
    e = spark.createDataFrame(edits, "k long, start long, end long, value string")
    assert {r.k: r.text for r in variants.splice(spark.createDataFrame(texts, "k long, text string"), e, "k").collect()} == want
    assert {(r.k, r.n): (r.s, r.e) for r in variants.shifted(spark.createDataFrame(spans, "k long, n long, s long, e long"), e, "k").collect()} == moved


def test_bad_edits_give_no_text(spark):
    texts = spark.createDataFrame([(i, "aé") for i in range(6)], "k long, text string")
    edits = [(0, 1, 2, "x"), (1, 0, 9, "x"), (2, 0, 2, "x"), (2, 1, 3, "y"), (3, 2, 1, "x"), (4, 1, 3, "x")]
    out = variants.splice(texts, spark.createDataFrame(edits, "k long, start long, end long, value string"), "k").collect()
    assert {r.k: r.text for r in out} == {0: None, 1: None, 2: None, 3: None, 4: "ax", 5: "aé"}


TRIO = [("f-a", "Größe {{candidate}}.", "sensitive", "sensitive"), ("f-b", "{{candidate}}", "neutral", "not-established"), ("f-c", "x {{candidate}}", "non-sensitive", "non-sensitive")]
CASE = dict(case_id="c", case_seed="s", method="schema-only", text="é 123-45", exp_start=3, exp_end=9, type_expectation="valid", sensitivity="non-sensitive", obligation=variants.OBLIGED, family="pii:global:number", jurisdiction=None, frames=TRIO, mutation=("invalidate-final-digit", 1), benign_class="sample", validator=None, version=None, competing=["pii:global:other"], cross_family=False, checks=None, evidence_method=None, evidence_classes=None)
SCHEMA = "case_id string, case_seed string, method string, text string, exp_start long, exp_end long, type_expectation string, sensitivity string, obligation string, family string, jurisdiction string, frames array<struct<id:string,template:string,context_class:string,sensitivity:string>>, mutation struct<id:string,version:int>, benign_class string, validator string, version int, competing array<string>, cross_family boolean, checks array<struct<validator:string,version:int,expected:string>>, evidence_method string, evidence_classes array<string>"


def assembled(spark, *changes, **rules):
    rows = [tuple((CASE | dict(case_id=f"c{i:02}") | c)[f.split()[0]] for f in SCHEMA.split(", ")) for i, c in enumerate(changes)]
    out = [[] for _ in changes]
    for r in variants.assembled(spark.createDataFrame(rows, SCHEMA), variants.Rules("generator", 2, "seeds", **rules)).collect():
        out[int(r.case_id[1:])].append(r)
    return out


def frame(n, **change):
    return [tuple(dict(zip(("id", "template", "context_class", "sensitivity"), f)) .__or__(change).values()) if i == n else f for i, f in enumerate(TRIO)]


CONTEXT = dict(method="context-discrimination")
REFUSED = [
    (dict(exp_end=None), "range-invalid"), (CONTEXT | dict(obligation=None), "context-case-invalid"), (CONTEXT | dict(type_expectation="invalid"), "context-case-invalid"), (CONTEXT | dict(frames=TRIO[:2]), "context-frames-not-a-trio"), (CONTEXT | dict(frames=None), "context-frames-not-a-trio"),
    (CONTEXT | dict(frames=frame(0, sensitivity="non-sensitive")), "frame-expectation-mismatch"), (CONTEXT | dict(frames=frame(1, template="none")), "frame-template-invalid"), (CONTEXT | dict(frames=frame(1, template="{{candidate}}{{candidate}}")), "frame-template-invalid"),
    (CONTEXT | dict(frames=frame(2, id="Not a slug")), "slot-invalid"), (CONTEXT | dict(frames=frame(2, id="f-a")), "duplicate-frame"), (CONTEXT | dict(frames=TRIO * 22), "too-many-variants"),
    (dict(method="mutation", mutation=("other", 1)), "operator-unknown"), (dict(method="mutation", mutation=("invalidate-final-digit", 2)), "operator-version-mismatch"), (dict(method="mutation", exp_end=7), "operator-not-applicable"), (dict(method="mutation", mutation=None), "operator-unknown"),
    (dict(method="type-validation"), "missing-validator"), (dict(method="reference-differential"), "missing-reference"), (dict(method="type-validation", validator="us-ssn-allocation", version=1), "validator-expectation-mismatch"), (dict(method="pii-benign", sensitivity="sensitive"), "not-non-sensitive"), (dict(method="pii-benign", benign_class="A b"), "slot-invalid"),
    (dict(method="jurisdiction-collision", competing=[]), "invalid-collision"),
]


def test_refusals(spark):
    got = assembled(spark, *[c for c, _ in REFUSED])
    assert [[r.reason for r in rows] for rows in got] == [[reason] for _, reason in REFUSED]
    assert all(r.variant_id is None and r.text is None and r.seed is None for rows in got for r in rows)


def test_variants_of_all_methods(spark):
    held = dict(validator="nobody", version=1)
    rows = assembled(spark, {}, dict(method="pii-benign"), dict(method="jurisdiction-collision"), dict(method="mutation"), dict(method="mutation", type_expectation="not-established", text="é 9", exp_start=3, exp_end=4), dict(method="type-validation", **held), dict(method="reference-differential", validator="us-ssn-allocation", version=1), dict(method="reference-differential", **held), CONTEXT)
    brief = [[(r.slot, r.text, r.start, r.end, r.type_expectation, r.sensitivity, r.context_class, r.strategy, r.operator, r.review) for r in sorted(x, key=lambda r: r.slot)] for x in rows]
    plain = lambda slot, strategy="authored", operator=None, review=None: [(slot, "é 123-45", 3, 9, "valid", "non-sensitive", "neutral", strategy, operator, review)]
    assert brief[:3] == [plain("authored"), plain("sample"), plain("collision")]
    assert brief[3] == [("mutated", "é 123-46", 3, 9, "invalid", "non-sensitive", "neutral", "derived", "invalidate-final-digit", None)]
    assert brief[4][0][1:5] == ("é 0", 3, 4, "not-established")
    assert brief[5:8] == [plain("validated", "review-required", "review-hold", "validator-unavailable"), plain("reference", review="reference-disagrees"), plain("reference", "review-required", "review-hold", "reference-unavailable")]
    assert [b[:4] + (b[5], b[6]) for b in brief[8]] == [("f-a", "Größe 123-45.", 8, 14, "sensitive", "sensitive"), ("f-b", "123-45", 0, 6, "not-established", "neutral"), ("f-c", "x 123-45", 2, 8, "non-sensitive", "non-sensitive")]
    fields = lambda *f: b"".join(len(x.encode()).to_bytes(4, "big") + x.encode() for x in f)
    for x in rows:
        for r in x:
            assert r.variant_id == f"{r.slot}-" + hashlib.sha256(fields(r.case_id, r.slot)).hexdigest()[:24]
            assert r.text_digest == hashlib.sha256(r.text.encode()).hexdigest()
            assert r.seed == (hashlib.sha256(fields("seeds", "generator", "2", "s", r.case_id, r.slot)).hexdigest() if r.strategy == "derived" else None)
    assert assembled(spark, CONTEXT, most_variants=2)[0][0].reason == "too-many-variants"
    assert assembled(spark, CONTEXT, most_bytes=12)[0][0].reason == "text-too-large"
