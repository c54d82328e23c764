"""Offsets of findings in code points, UTF-16 units or bytes as byte offsets, by an index that is built once for each text.

Texts and findings meet in bins of whole texts, about ``BIN_BYTES`` each, and findings travel without their text. A bin's texts lie end to end; one array
has the byte at which each character begins and one the UTF-16 unit, and all offsets of a bin are looked up in them at once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of texts that a task indexes at once, on average; one text may have more.
BIN_BYTES = 4 << 20
UNITS = ("bytes", "utf16", "points")


class Index:
    """Where the characters of several texts begin, in bytes and UTF-16 units of all texts end to end."""

    def __init__(self, texts: list[bytes]):
        raw = np.frombuffer(b"".join(texts), np.uint8)
        ends = np.cumsum([0, *map(len, texts)])
        heads = np.flatnonzero((raw & 0xC0) != 0x80)
        wide = (raw[heads] >= 0xF0).astype(np.int64)
        #: By character and one more at the end.
        self.byte = np.append(heads, len(raw))
        self.unit = np.concatenate([[0], np.cumsum(1 + wide)])
        #: By text, what lies before it and after its end.
        self.bytes = ends
        self.points = np.searchsorted(self.byte[:-1], ends)
        self.units = self.unit[self.points]

    def byte_of(self, text: np.ndarray, at: np.ndarray, unit: str) -> np.ndarray:
        """The byte offset in its text of each offset; -1 before or beyond the text or inside a surrogate pair. Bytes are only kept within the text."""
        base = {"bytes": self.bytes, "utf16": self.units, "points": self.points}[unit]
        inside = (at >= 0) & (at <= base[text + 1] - base[text])
        here = np.where(inside, at, 0) + base[text]
        if unit == "bytes":
            return np.where(inside, at, -1)
        if unit == "utf16":
            char = np.searchsorted(self.unit, here)
            inside &= self.unit[char] == here
            here = char
        return np.where(inside, self.byte[here] - self.bytes[text], -1)

    def is_boundary(self, text: np.ndarray, at: np.ndarray) -> np.ndarray:
        here = self.bytes[text] + at
        return self.byte[np.searchsorted(self.byte, here)] == here


def _translated(key: str, unit: str):
    def run(texts: pa.Table, found: pa.Table) -> pa.Table:
        n = found.num_rows
        start, end, fits = np.full(n, -1), np.full(n, -1), np.zeros(n, bool)
        place = pc.index_in(found[key], texts[key]) if texts.num_rows and n else pa.nulls(n, pa.int32())
        use = pc.and_(pc.is_valid(place), pc.and_(found["start"].is_valid(), found["end_"].is_valid()))
        rows = np.flatnonzero(use.to_numpy(zero_copy_only=False))
        if len(rows):
            wanted, own = np.unique(place.take(pa.array(rows)).to_numpy(), return_inverse=True)
            index = Index(texts["text"].take(pa.array(wanted)).to_pylist())
            s, e = (index.byte_of(own, found[c].take(pa.array(rows)).to_numpy(), unit) for c in ("start", "end_"))
            good = (s >= 0) & (s < e)
            good[good] = index.is_boundary(own[good], s[good]) & index.is_boundary(own[good], e[good])
            start[rows], end[rows], fits[rows] = s, e, good
        cols = [pa.array(v, pa.int64(), mask=v < 0) for v in (start, end)]
        return pa.table([*found.columns, *cols, pa.array(fits)], names=[*found.column_names, "f_start", "f_end", "fits"]).drop_columns(["text_bin"])

    return run


def to_bytes(found: DataFrame, texts: DataFrame, key: str, unit: str) -> DataFrame:
    """found with f_start, f_end and fits, from start and end_ in ``unit`` (bytes, utf16 or points).

    texts: (key, text), one row a key; keys may not be null there. Offsets outside the text or inside a surrogate pair are null. fits tells whether the
    range holds something and lies between whole characters; it is false for null offsets and for findings of no text. Repeated
    findings stay; what isn't in found's columns plus the three is none of this function's business.
    """
    if unit not in UNITS:
        raise ValueError(f"unit must be one of {UNITS}")
    spans = found.withColumns({"start": F.col("start").cast("long"), "end_": F.col("end_").cast("long")})
    texts = texts.select(key, F.col("text").cast("string").cast("binary").alias("text")).where("text is not null")
    total = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    text_bin = F.pmod(F.xxhash64(key), F.lit(max(1, -(-total // BIN_BYTES)))).alias("text_bin")
    schema = T.StructType([*spans.schema.fields, T.StructField("f_start", T.LongType()), T.StructField("f_end", T.LongType()), T.StructField("fits", T.BooleanType())])
    held = texts.select("*", text_bin).groupBy("text_bin")
    return held.cogroup(spans.select("*", text_bin).groupBy("text_bin")).applyInArrow(_translated(key, unit), schema)
