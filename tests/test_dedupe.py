import random
from datetime import datetime, timedelta

from tallyspan.streaming import dedupe

T0 = datetime(2024, 1, 1)


def brute(rows, ttl):
    kept, last = set(), {}
    for k, t, i in sorted(rows, key=lambda r: (r[1], r[2])):
        if k not in last or (t - last[k]).total_seconds() >= ttl:
            last[k] = t
            kept.add(i)
    return kept


def test_one_that_comes_exactly_at_the_end_is_new(spark):
    rows = [("a", T0 + timedelta(seconds=s), s) for s in (0, 9, 10, 19, 20)]
    df = spark.createDataFrame(rows, "k string, ts timestamp, id long")
    assert {r.id for r in dedupe.first_within(df, ["k"], "ts", "id", 10).collect()} == {0, 10, 20}


def test_batch_equals_brute_force_with_a_hot_key_and_null_keys(spark):
    r = random.Random(1)
    rows = [(r.choice(["hot", "hot", "hot", "a", None]), T0 + timedelta(seconds=r.choice([0, 500, 3000]) + r.randrange(200)), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "k string, ts timestamp, id long").repartition(5)
    assert {x.id for x in dedupe.first_within(df, ["k"], "ts", "id", 10).collect()} == brute(rows, 10)


def streamed(spark, folder, batches, ttl, lateness):
    """Ids that the stream gives out when each list of rows comes in a micro-batch of its own, and then one that ends all waiting."""
    schema = "k string, ts timestamp, id long"
    for n, rows in enumerate([*batches, [("end", T0 + timedelta(days=900), -1)], [("end", T0 + timedelta(days=990), -2)]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder / "in" / f"{n:03}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(str(folder / "in" / "*"))
    name = f"kept_{folder.name.replace('-', '_')}"
    q = dedupe.stream_first_within(stream, ["k"], "ts", "id", ttl, lateness).writeStream.format("memory").queryName(name).option("checkpointLocation", str(folder / "check")).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    return sorted(r.id for r in spark.table(name).collect() if r.id >= 0)


def test_stream_equals_batch_over_micro_batches(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(dedupe, "HELD", 7)
    r = random.Random(4)
    rows = [(r.choice(["hot", "hot", "a"]), T0 + timedelta(milliseconds=r.randrange(120_000)), i) for i in range(400)]
    rows.sort(key=lambda x: x[1] + timedelta(seconds=r.randrange(20)))  # each at most 20 s late
    batches = [rows[a : a + 80] for a in range(0, 400, 80)]
    assert streamed(spark, tmp_path, batches, "10 seconds", "30 seconds") == sorted(brute(rows, 10))


def test_what_comes_too_late_is_dropped(spark, tmp_path):
    at = lambda s, i: ("a", T0 + timedelta(seconds=s), i)
    # The row at 30 s brings the watermark to 25 s, which counts from the batch after the next; a row of 3 s is too late by then, one of 26 s isn't.
    assert streamed(spark, tmp_path, [[at(0, 0)], [at(30, 1)], [at(31, 5)], [at(3, 2), at(26, 3)], [at(36, 4)]], "2 seconds", "5 seconds") == [0, 1, 3, 4]


def test_days(spark, tmp_path):
    rows = [("a", T0 + timedelta(days=d), i) for i, d in enumerate((0, 0.5, 1, 1.5, 3, 3.2))] + [("b", T0, 9)]
    assert streamed(spark, tmp_path, [rows], "1 day", "4 days") == [0, 2, 4, 9]
