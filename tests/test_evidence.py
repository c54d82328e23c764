from decimal import Decimal
from fractions import Fraction

import pytest
from hypothesis import given
from hypothesis import strategies as st

from tallyspan.functions import exchange, stats
from tallyspan.operators import evidence, outputs


@pytest.mark.parametrize(
    ("raw", "defect"),
    [
        (b'{"a":[1,{"b":"x"}]}', None),
        (b"9007199254740991", None),
        (b"-9007199254740992", "integer-out-of-range"),
        (b"18446744073709551616", "float-not-allowed"),
        (b"1e2", "float-not-allowed"),
        (b"NaN", "malformed-json"),
        (b'"\xff"', "malformed-json"),
        (b'"\\ud800"', "malformed-json"),
        (b"[" * 100_000, "nesting-too-deep"),
        (b'{"a":{"b":1,"b":1}}', "duplicate-key"),
        (b"", "malformed-json"),
    ],
)
def test_strict_json(raw, defect):
    assert exchange.inspect(raw) == (defect, False)


def test_banned_keys_are_found_at_any_depth():
    assert exchange.inspect(b'[{"a":{"myScore":1}}]') == (None, True)
    assert exchange.inspect(b'["score"]') == (None, False)


@given(st.floats(0, 1))
def test_to_fixed_rounds_the_exact_value_half_up(x):
    assert stats.to_fixed(x) == int(Fraction(x) * 10**6 + Fraction(1, 2))


def test_to_fixed_ties():
    assert stats.to_fixed(0.5, 0) == 1 and stats.to_fixed(0.125, 2) == 13 and stats.to_fixed(1.005, 2) == int(Decimal(1.005) * 100)


def judged(spark, text, sanitized, *spans):
    texts = spark.createDataFrame([(1, text, sanitized)], "k int, text string, sanitized string")
    held = spark.createDataFrame([(1, i, a, b) for i, (a, b) in enumerate(spans)], "k int, occurrence_id int, start long, end long")
    rows = outputs.verify_outputs(held, texts, "k").orderBy("occurrence_id").collect()
    return [r.refusal or r.verdict for r in rows]


def test_verify_outputs(spark):
    gone, left, other = "removed", "residual-present", "collateral-change"
    assert judged(spark, "a SECRET b", "a  b", (2, 8)) == [gone]
    assert judged(spark, "a SECRET b", "a [SECRET] b", (2, 8)) == [left]
    assert judged(spark, "a SECRET b", "A  b", (2, 8)) == [other]
    assert judged(spark, "a SECRET b", "SECRET", (2, 8)) == [left]
    assert judged(spark, "aXYb", "ab", (1, 2), (2, 3)) == [gone, gone]
    assert judged(spark, "aXYb", "aYb", (1, 2), (1, 3)) == [gone, gone]
    assert judged(spark, "éXüY", "éü", (2, 3), (5, 6)) == [gone, gone]
    assert judged(spark, "aXa", "a", (1, 2)) == [other]
    assert judged(spark, "X-Y-Z", "-1--", (0, 1), (2, 3), (4, 5)) == [gone, gone, gone]
    assert judged(spark, "éX", "X", (1, 2)) == ["range"]
    assert judged(spark, "abc", "abc", *[(0, 1)] * 17) == ["too-many-occurrences"] * 17
    assert judged(spark, "abc", None, (0, 1)) == [None]


def test_mapping_with_nulls(spark):
    rows = spark.createDataFrame([(1, None, "invalid", "non-sensitive", None, None), (1, 3, "valid", "context-dependent", ["x"], ["phi"])], "case_id int, start long, identity string, sensitivity string, contexts array<string>, domains array<string>")
    plain = {r.start: r for r in evidence.mapped(rows).collect()}
    assert plain[None].type_expectation == "not-established" and plain[None].losses == ["identity-weakened-no-span", "sensitivity-weakened-no-span"]
    assert plain[3].losses == ["sensitivity-context-flattened", "contexts-not-carried", "phi-domain-not-carried"]
    full = {r.start: r for r in evidence.mapped(rows, semantics=True).collect()}
    assert full[None].text_negative and full[None].type_expectation == "invalid" and not full[None].losses and not full[3].losses
    assert full[3].sensitivity_expectation == "context-dependent"
    assert {(r.located, r.method) for r in evidence.case_methods(rows).collect()} == {(False, "schema-only"), (True, "type-validation")}
