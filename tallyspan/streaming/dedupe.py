"""Delivery de-duplication: a delivery is kept if no kept one of the same key lies less than the time to live before it.

A duplicate doesn't refresh the timer, so the rule runs along each key's deliveries in order. A delivery that comes at least the time
to live after the one before it is new whatever was kept, so keys are split there first. The batch form then streams sorted rows and
carries one time; the streaming form lets rows wait in state until the watermark has passed them, and judges them in the same order.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

#: Rows of a key that the streaming form holds before it puts them into state.
HELD = 1000


def _segments(rows: DataFrame, keys: list[str], ttl: int) -> DataFrame:
    """rows with dd_group, which tells keys apart and parts of a key with a gap of ``ttl`` between them.

    Spans of ``ttl`` have no such gap inside, so the first and last time of each span tell where the gaps are.
    """
    rows = rows.withColumn("dd_key", F.to_json(F.struct(*keys))).withColumn("dd_span", F.floor(F.col("dd_us") / F.lit(max(ttl, 1))))
    spans = rows.groupBy("dd_key", "dd_span").agg(F.min("dd_us").alias("first"), F.max("dd_us").alias("last"))
    order = W.partitionBy("dd_key").orderBy("dd_span")
    spans = spans.withColumn("gap", F.coalesce((F.col("first") - F.lag("last").over(order) >= ttl).cast("int"), F.lit(1)))
    spans = spans.select(F.col("dd_key").alias("dd_k"), F.col("dd_span").alias("dd_s"), F.sum("gap").over(order).alias("dd_part"))
    found = rows.join(spans, (F.col("dd_key") == F.col("dd_k")) & F.col("dd_span").eqNullSafe(F.col("dd_s")))
    return found.withColumn("dd_group", F.concat_ws("|", F.col("dd_part").cast("string"), "dd_key")).drop("dd_key", "dd_span", "dd_k", "dd_s", "dd_part")


def first_within(rows: DataFrame, keys: list[str], time: str, order: str, ttl_seconds: int) -> DataFrame:
    """The kept rows (keys, time, order) of a batch table. Rows without a time are all kept."""
    ttl = ttl_seconds * 1_000_000
    rows = rows.select(*keys, F.col(time).cast("timestamp").alias(time), order).withColumn("dd_us", F.unix_micros(time))
    parts = _segments(rows, keys, ttl).repartition("dd_group").sortWithinPartitions("dd_group", "dd_us", order)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, last = None, None
        for batch in batches:
            new = []
            for g, t in zip(batch.column("dd_group").to_pylist(), batch.column("dd_us").to_pylist()):
                if g != group:
                    group, last = g, None
                new.append(t is None or last is None or t - last >= ttl)
                last = t if new[-1] else last
            yield batch.filter(pa.array(new, pa.bool_()))

    return parts.mapInArrow(walk, parts.schema).select(*keys, time, order)


class _FirstWithin(StatefulProcessor):
    """Rows wait by millisecond until the watermark has passed them; then they are judged in order against the one time that is kept."""

    def __init__(self, ttl: int, names: list[str], time: str, order: str):
        self.ttl, self.names, self.time, self.order = ttl, names, time, order

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "ms long", "rows binary")
        self.kept = handle.getValueState("kept", "us long")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        fresh: dict[int, list[tuple]] = {}
        for n, row in enumerate(rows, 1):
            fresh.setdefault(row["dd_us"] // 1000, []).append((row["dd_us"], row[self.order], tuple(row[c] for c in self.names)))
            if n % HELD == 0:
                self._wait(fresh)
        self._wait(fresh)
        return iter(())

    def _wait(self, fresh: dict[int, list[tuple]]) -> None:
        for ms, rows in fresh.items():
            old = pickle.loads(self.waiting.getValue((ms,))[0]) if self.waiting.containsKey((ms,)) else []
            if not old:
                self.handle.registerTimer(ms + 1)
            self.waiting.updateValue((ms,), (pickle.dumps(old + rows),))
        fresh.clear()

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:
        now = timerValues.getCurrentWatermarkInMs()
        last = self.kept.get()[0] if self.kept.exists() else None
        for ms in sorted(k[0] for k in self.waiting.keys() if k[0] < now):
            for us, _, values in sorted(pickle.loads(self.waiting.getValue((ms,))[0]), key=lambda r: r[:2]):
                if last is None or us - last >= self.ttl:
                    last = us
                    yield Row(**dict(zip(self.names, values)))
            self.waiting.removeKey((ms,))
        if last is not None and last + self.ttl <= now * 1000:
            self.kept.clear()
        elif last is not None:
            self.kept.update((last,))
            self.handle.registerTimer((last + self.ttl) // 1000 + 1)

    def close(self) -> None:
        pass


def stream_first_within(rows: DataFrame, keys: list[str], time: str, order: str, ttl: str, lateness: str) -> DataFrame:
    """The streaming form: the rows that ``first_within`` keeps, whatever micro-batches they come in, if none is later than ``lateness``.

    A row is given out when the watermark, the latest time less ``lateness``, has passed it; so the last rows wait until others come. Rows later than that are
    dropped before they reach the state, and so are rows without a time. A key's state is the rows that wait, by millisecond, and one time, which is forgotten when its
    time to live has passed. Rows of a key stream through; HELD of them are in memory at once. The session gets the RocksDB state store, which timers need.
    """
    spark = rows.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    us = spark.sql(f"SELECT unix_micros(timestamp_micros(0) + INTERVAL '{ttl}')").first()[0]
    marked = rows.withWatermark(time, lateness).withColumn("dd_us", F.unix_micros(F.col(time).cast("timestamp"))).where("dd_us is not null")
    return marked.groupBy(*keys).transformWithState(_FirstWithin(us, rows.columns, time, order), rows.schema, "Append", "EventTime")
