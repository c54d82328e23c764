"""Detectors over whole texts as a table function, with replays: findings come from running them, not from a file.

A detector is a name in a registry of small functions from the bytes of a text to ranges. All detectors read a text in one pass over a batch.
Each is run as often as asked; an input whose runs differ, as multisets of findings, makes its scanner unstable.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: From the UTF-8 bytes of a text and the number of the run to (start, end, family, sensitive); offsets in bytes.
Detector = Callable[[bytes, int], Iterator[tuple[int, int, str, bool | None]]]
#: Rows of a batch that are scanned at once.
ROWS = 256


def pattern(regex: str, family: str, sensitive: bool | None = None) -> Detector:
    """A detector of an ASCII pattern."""
    find = re.compile(regex.encode("ascii")).finditer

    def run(text: bytes, replay: int) -> Iterator[tuple[int, int, str, bool | None]]:
        return ((m.start(), m.end(), family, sensitive) for m in find(text))

    return run


def luhn(regex: str, family: str) -> Detector:
    """Digit runs of a pattern whose check digit is right; they are sensitive."""
    find = re.compile(regex.encode("ascii")).finditer

    def sound(digits: bytes) -> bool:
        n = [c - 48 for c in digits[::-1]]
        return (sum(n[::2]) + sum(sum(divmod(2 * d, 10)) for d in n[1::2])) % 10 == 0

    def run(text: bytes, replay: int) -> Iterator[tuple[int, int, str, bool | None]]:
        return ((m.start(), m.end(), family, True) for m in find(text) if sound(m[0]))

    return run


def flaky(detector: Detector, every: int) -> Detector:
    """A detector that misses a finding now and then in runs after the first; to see that replays notice."""

    def run(text: bytes, replay: int) -> Iterator[tuple[int, int, str, bool | None]]:
        return (f for i, f in enumerate(detector(text, replay)) if not replay or i % every != every - 1)

    return run


_SCHEMA = "replay int, scanner_id long, variant_id long, emission long, f_start long, f_end long, f_family string, f_jurisdiction string, f_sensitive boolean, f_action string"


def scan(texts: DataFrame, detectors: dict[int, Detector], replays: int = 2, most: int = 100_000) -> DataFrame:
    """Findings (replay, scanner_id, variant_id, emission, f_start, f_end, f_family, f_jurisdiction, f_sensitive, f_action) of texts (variant_id, text).

    emission counts a text's findings of one scanner and run from 0. Null texts have none. A detector that gives more than ``most`` findings of
    a text fails the query, as an input may not be cut short.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(a, ROWS) for a in range(0, len(batch), ROWS)):
                rows = []
                for variant, text in zip(part["variant_id"].to_pylist(), part["text"].to_pylist()):
                    for scanner, detect in detectors.items():
                        for replay in range(replays):
                            found = [(replay, scanner, variant, i, s, e, family, None, sensitive, None) for i, (s, e, family, sensitive) in enumerate(detect(text, replay))]
                            if len(found) > most:
                                raise ValueError(f"scanner {scanner} has more than {most} findings in input {variant}")
                            rows += found
                yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in rows], schema=arrow)

    names = [c.split()[0] for c in _SCHEMA.split(", ")]
    kinds = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}
    arrow = pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in _SCHEMA.split(", ")])
    rows = texts.select(F.col("variant_id").cast("long").alias("variant_id"), F.col("text").cast("string").cast("binary").alias("text")).where("text is not null")
    return rows.mapInArrow(run, _SCHEMA)


def unstable_inputs(found: DataFrame, replays: int) -> DataFrame:
    """(scanner_id, variant_id) of inputs whose runs differ as multisets of findings: each finding must stand in every run as often."""
    parts = ["scanner_id", "variant_id", "f_start", "f_end", "f_family", "f_jurisdiction", "f_sensitive", "f_action"]
    runs = [F.count_if(F.col("replay") == r) for r in range(replays)]
    odd = found.groupBy(*parts).agg(F.array(*runs).alias("n")).where(F.array_min("n") != F.array_max("n"))
    return odd.select("scanner_id", "variant_id").distinct()


def statuses(spark: SparkSession, detectors: dict[int, Detector], found: DataFrame, replays: int) -> DataFrame:
    """(scanner_id, status, unstable): complete, or unstable with the number of inputs whose runs differ."""
    odd = unstable_inputs(found, replays).groupBy("scanner_id").agg(F.count("*").alias("n"))
    rows = spark.createDataFrame([(i,) for i in detectors], "scanner_id long").join(odd, "scanner_id", "left")
    return rows.select("scanner_id", F.when(F.col("n").isNull(), "complete").otherwise("unstable").alias("status"), F.coalesce("n", F.lit(0)).cast("long").alias("unstable"))
