from datetime import datetime, timedelta

from tallyspan.streaming import dedupe

T0 = datetime(2024, 1, 1)


def test_a_duplicate_does_not_refresh_the_timer(spark):
    rows = [("a", T0 + timedelta(seconds=s), i) for i, s in enumerate((0, 6, 11, 15, 40))] + [("b", T0, 9)]
    df = spark.createDataFrame(rows, "k string, ts timestamp, id long")
    assert sorted(r.id for r in dedupe.first_within(df, ["k"], "ts", "id", 10).collect()) == [0, 2, 4, 9]
