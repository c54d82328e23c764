from pyspark.sql import functions as F

from tallyspan.functions import exchange, ranges, reasons
from tallyspan.operators import verify


def test_reasons_are_known_once_and_rules_lead_to_them(spark):
    assert len(reasons.ALL) == len(set(reasons.ALL)) == 62 and set(reasons.STANDS_FOR.values()) <= set(reasons.ALL)
    rows = spark.createDataFrame([("range-invalid",), ("unreachable-type",), ("other",), (None,)], "c string")
    assert [r[0] for r in rows.select(reasons.reason(F.col("c"))).collect()] == ["range-invalid", "outcome-contradiction", None, None]
    assert hasattr(exchange, "strict_json") and set(verify.REACHABLE) == {"valid", "invalid", "not-established"}


def test_ranges_of_raw_bytes(spark):
    rows = [(b"a\xc3", 0, 1), (b"a\xc3\xa9", 0, 2), (b"a\xc3\xa9", 0, 3), (b"", 0, 0), (b"ab", 1, 3)]
    df = spark.createDataFrame([(bytearray(b), s, e) for b, s, e in rows], "b binary, s long, e long")
    assert [r[0] for r in df.select(ranges.range_error_bytes(F.col("b"), F.col("s"), F.col("e"))).collect()] == ["not-utf8", "not-a-boundary", None, "empty", "out-of-bounds"]
