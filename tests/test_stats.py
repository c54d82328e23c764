from math import sqrt

from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyspan.functions import stats


@given(st.integers(4, 5000).flatmap(lambda n: st.tuples(st.integers(0, n), st.just(n))))
def test_wilson_agrees_with_floats(kn):
    k, n = kn
    for upper, sign in ((True, 1), (False, -1)):
        want = (2 * k + 1.96**2 + sign * 1.96 * sqrt(1.96**2 + 4 * k * (n - k) / n)) / (2 * (n + 1.96**2))
        assert abs(stats.wilson(k, n, upper) - max(0, min(1, want)) * 1e6) <= 0.51


def test_published_values(spark):
    rows = [(1, 8, True, 125000, 470895), (2, 6, True, 333333, 700012), (2, 7, True, 285714, 641071), (1, 7, True, 142857, 513135), (17, 24, False, 708333, 508319)]
    df = spark.createDataFrame(rows, "k long, n long, up boolean, point long, bound long")
    out = df.select(stats.point_mantissa(F.col("k"), F.col("n")) == F.col("point"), stats.wilson_mantissa(F.col("k"), F.col("n"), F.col("up")) == F.col("bound")).collect()
    assert all(a and b for a, b in out)


def test_withheld(spark):
    df = spark.createDataFrame([(0,), (3,), (4,)], "n long").select(stats.value_state(F.col("n")).alias("s"))
    assert [r.s for r in df.collect()] == ["zero-denominator", "insufficient-evidence", "published"]
