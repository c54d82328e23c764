from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyspan.functions import identity, ranges

TEXT = "a😀한b\r\né"


def one(spark, *cols):
    return tuple(spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).first())


def test_relation_and_closeness(spark):
    lit = lambda *x: [F.lit(i) for i in x]
    assert one(spark, *(ranges.relation(*lit(10, 20, a, b)) for a, b in ((10, 20), (8, 21), (12, 25), (20, 30)))) == ("exact", "overbroad", "partial", "none")
    assert one(spark, *ranges.closeness(*lit(10, 20, 8, 21)), *ranges.closeness(*lit(10, 20, 12, 25))) == (1, 3, 2, 2)


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.integers(0, 8))
def test_units_go_there_and_back(spark, i):
    text = F.lit(TEXT)
    if i > len(TEXT):
        assert one(spark, ranges.byte_of_point(text, F.lit(i))) == (None,)
        return
    at, units = len(TEXT[:i].encode()), len(TEXT[:i].encode("utf-16-be")) // 2
    assert one(spark, ranges.byte_of_point(text, F.lit(i)), ranges.point_of_byte(text, F.lit(at)), ranges.byte_of_utf16(text, F.lit(units))) == (at, i, at)


def test_boundaries_and_defects(spark):
    text = F.lit(TEXT)
    ends = {len(TEXT[:i].encode()) for i in range(len(TEXT) + 1)}
    size = len(TEXT.encode())
    assert one(spark, *(ranges.is_boundary(text, F.lit(i)) for i in range(size + 1))) == tuple(i in ends for i in range(size + 1))
    found = one(spark, *(ranges.range_error(text, F.lit(a), F.lit(b)) for a, b in ((3, 1), (1, 1), (0, 99), (2, 5), (1, 5))))
    assert found == ("inverted", "empty", "out-of-bounds", "not-a-boundary", None)
    assert one(spark, ranges.byte_of_utf16(text, F.lit(2))) == (None,)


def test_identity(spark):
    import hashlib

    want = hashlib.sha256(b"\0\0\0\6case-a\0\0\0\x08authored").hexdigest()[:24]
    assert one(spark, identity.variant_id(F.lit("case-a"), F.lit("authored"))) == ("authored-" + want,)
    states = one(spark, *(identity.us_ssn_allocation(F.lit(v)) for v in ("123456789", "123-45-6789", "000456789", "900456789", "123006789", "123450000", "123456789\n", "x")))
    assert states == ("valid",) + ("invalid",) * 7
    assert one(spark, *(identity.synthetic_mod10(F.lit(v)) for v in ("SYNTHETIC-1236", "SYNTHETIC-1235", "SYNTHETIC-1236\n"))) == ("valid", "invalid", "invalid")
    assert one(spark, identity.invalidate_final_digit(F.lit("ab19x")), identity.invalidate_final_digit(F.lit("none"))) == ("ab10x", "none")
    assert one(spark, *identity.framed(F.lit("é {{candidate}}!"), F.lit("v")), identity.framed(F.lit("none"), F.lit("v"))[0]) == ("é v!", 3, None)
