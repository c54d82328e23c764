"""Half-open ranges of UTF-8 bytes: overlap, relation, closeness, structure, boundaries, unit translation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The largest offset that an exchange format may hold.
LARGEST = 2**53 - 1


def overlaps(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    return (a0 < b1) & (b0 < a1)


def relation(e0: Column, e1: Column, f0: Column, f1: Column) -> Column:
    """exact, overbroad (covers all and more), partial, or none, of a reported range against an expected one."""
    return F.when((e0 == f0) & (e1 == f1), "exact").when((f0 <= e0) & (f1 >= e1), "overbroad").when(overlaps(e0, e1, f0, f1), "partial").otherwise("none")


def closeness(e0: Column, e1: Column, f0: Column, f1: Column) -> tuple[Column, Column]:
    """(rank, tightness): less is closer. Overbroad ranges count what they add, which is nothing for exact ones, partial ones what they miss.

    Each test stands once: in a function over an array Spark works out an expression as often as it stands.
    """
    covers = (f0 <= e0) & (f1 >= e1)
    rank = F.when((e0 == f0) & (e1 == f1), 0).when(covers, 1).otherwise(2)
    shared = F.least(e1, f1) - F.greatest(e0, f0)
    return rank, F.when(covers, (f1 - f0) - (e1 - e0)).otherwise((e1 - e0) - shared).cast("long")


def structure_error(start: Column, end: Column) -> Column:
    """The first defect of a range, or null."""
    return F.when(start > end, "inverted").when(start == end, "empty").when(end > LARGEST, "too-large")


def is_boundary(text: Column, at: Column) -> Column:
    """Whether a byte offset lies between two characters: the byte there doesn't continue a character."""
    code = F.conv(F.hex(F.substring(F.encode(text, "UTF-8"), (at + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return (at == F.octet_length(text)) | (code.bitwiseAND(192) != 128)


def range_error(text: Column, start: Column, end: Column) -> Column:
    """The first defect of a range in a text: its structure, its bounds, then its character boundaries; or null."""
    out = F.when(end > F.octet_length(text), "out-of-bounds").when(~is_boundary(text, start) | ~is_boundary(text, end), "not-a-boundary")
    return F.coalesce(structure_error(start, end), out)


def unit_lengths(text: Column) -> tuple[Column, Column, Column]:
    """Length in UTF-8 bytes, UTF-16 units and code points."""
    return F.octet_length(text).cast("long"), (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("long"), F.char_length(text).cast("long")


def byte_of_point(text: Column, points: Column) -> Column:
    """The byte offset of a code point offset; null beyond the text."""
    return F.when((points >= 0) & (points <= F.char_length(text)), F.octet_length(F.substring(text, F.lit(1), points.cast("int")))).cast("long")


def point_of_byte(text: Column, at: Column) -> Column:
    """The code point offset of a byte offset; null if it isn't a boundary or lies beyond the text."""
    before = F.decode(F.substring(F.encode(text, "UTF-8"), F.lit(1), at.cast("int")), "UTF-8")
    return F.when((at <= F.octet_length(text)) & is_boundary(text, at), F.char_length(before)).cast("long")


def byte_of_utf16(text: Column, units: Column) -> Column:
    """The byte offset of a UTF-16 offset; null inside a surrogate pair or beyond the text."""
    wide = F.encode(text, "UTF-16BE")
    lead = F.conv(F.hex(F.substring(wide, (units * 2 + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    inside = (units * 2 < F.octet_length(wide)) & lead.between(0xDC, 0xDF)
    part = F.decode(F.substring(wide, F.lit(1), (units * 2).cast("int")), "UTF-16BE")
    return F.when((units * 2 <= F.octet_length(wide)) & ~inside, F.octet_length(part)).cast("long")


def every_match(rows: DataFrame, text: str, pattern: str) -> DataFrame:
    """rows with start, end_ and token of each match of a pattern: byte offsets, from the lengths of what lies before.

    The text is the parts between matches and the matches in turn, so a running sum of their lengths places each.
    """
    runs = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    found = rows.withColumn("runs", runs).where(F.size("runs") > 0).withColumn("parts", F.split(text, pattern, -1))
    size = lambda c: F.octet_length(c).cast("long")
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,end_:bigint,token:string>>").alias("spans"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + size(x["parts"])
        one = F.struct(start.alias("start"), (start + size(x["runs"])).alias("end_"), x["runs"].alias("token"))
        return F.struct(one["end_"].alias("at"), F.concat(acc["spans"], F.array(one)).alias("spans"))

    pairs = F.filter(F.arrays_zip("parts", "runs"), lambda x: x["runs"].isNotNull())
    return found.withColumn("span", F.explode(F.aggregate(pairs, zero, step)["spans"])).select(*rows.columns, "span.start", "span.end_", "span.token")


def range_error_bytes(raw: Column, start: Column, end: Column) -> Column:
    """The first defect of a range in bytes that should be a text: not-utf8 before all others."""
    text = F.try_validate_utf8(raw.cast("string"))
    return F.when(text.isNull(), "not-utf8").otherwise(range_error(text, start, end))
