"""Pairs of overlapping ranges of the same key, by bins of positions.

Both sides are dealt into bins of ``WIDTH`` positions and meet on the key and the bin, so a key with very many rows spreads over its
positions, and rows are compared with their neighbours alone. A pair that shares several bins counts in the bin of its later start, which both
ranges reach. A range of n positions has at most n / WIDTH + 2 copies; texts are bounded by contract (1 MiB), so copies are as well.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ranges

#: Positions of a bin: several times a usual range, so that most ranges lie in one.
WIDTH = 1024


def bins(start: Column, end: Column, width: int = WIDTH) -> Column:
    """The bins that a half-open range reaches; none for null or empty ranges."""
    at = lambda c: F.floor(c / width).cast("long")
    return F.when(start < end, F.sequence(at(start), at(end - 1)))


def overlapping(left: DataFrame, right: DataFrame, key: str, a: tuple[str, str], b: tuple[str, str], width: int = WIDTH) -> DataFrame:
    """left join right where the keys agree and the ranges a of left and b of right overlap, with a column ``bin``.

    The sides share no column but the key. Each pair comes once. Empty, inverted and null ranges, and null keys, meet nothing.
    """
    (l, r) = (df.withColumn("bin", F.explode(bins(*map(F.col, at), width))) for df, at in ((left, a), (right, b)))
    pairs = l.join(r, [key, "bin"])
    later = F.floor(F.greatest(a[0], b[0]) / width).cast("long") == F.col("bin")
    return pairs.where(later & ranges.overlaps(F.col(a[0]), F.col(a[1]), F.col(b[0]), F.col(b[1])))
