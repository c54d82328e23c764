"""Exact rates: rounded ratios and Wilson bounds in integers, published only with enough evidence."""

from __future__ import annotations

from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Decimal
from math import isqrt

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

#: Defaults of a measurement: least denominator, z as mantissa and scale, decimal places.
LEAST_N, Z, Z_SCALE, PLACES = 4, 196, 2, 6


def point_mantissa(k: Column, n: Column, places: int = PLACES) -> Column:
    """k / n rounded half up, times 10 ** places."""
    return F.floor((k.cast("decimal(20,0)") * F.lit(2 * 10**places).cast("decimal(10,0)") + n) / (n * 2)).cast("long")


def wilson(k: int, n: int, upper: bool, z: int = Z, z_scale: int = Z_SCALE, places: int = PLACES) -> int:
    """One end of the Wilson interval, rounded half up once, times 10 ** places, in exact integers.

    With p = k / n and q = z^2 the end is (2 k + q +- z sqrt(q + 4 k (n - k) / n)) / (2 (n + q)).
    """
    unit, q = 10 ** (2 * z_scale), z * z
    below = 2 * (n * unit + q)
    inner = q * (q * n + 4 * k * (n - k) * unit) * n
    scaled = 2 * 10**places
    square = scaled * scaled * inner
    root = isqrt(square)
    middle = scaled * (2 * k * unit + q) * n + below * n
    if not upper:
        root = root if root * root == square else root + 1
        return max(0, middle - root) // (2 * below * n)
    return min(10**places, (middle + root) // (2 * below * n))


@F.pandas_udf(LongType())
def _wilson(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for k, n, up in parts:
        yield pd.Series([wilson(int(a), int(b), bool(u)) if b else 0 for a, b, u in zip(k, n, up)])


def wilson_mantissa(k: Column, n: Column, upper: Column) -> Column:
    """The bound in the metric's direction; a Python UDF, for tables of aggregates only."""
    return _wilson(k, n, upper)


def value_state(n: Column, least: int = LEAST_N) -> Column:
    return F.when(n == 0, "zero-denominator").when(n < least, "insufficient-evidence").otherwise("published")


def to_fixed(x: float, places: int = PLACES) -> int:
    """The exact value of a binary float times 10 ** places, rounded half up."""
    return int(Decimal(x).scaleb(places).to_integral_value(ROUND_HALF_UP))


@F.pandas_udf(LongType())
def _to_fixed(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for part in parts:
        yield pd.Series([None if x is None or pd.isna(x) else to_fixed(x) for x in part], dtype="Int64")


def legacy_rate(k: Column, n: Column, upper: Column, z: float = 1.96) -> tuple[Column, Column]:
    """(point, bound) as older reports round them: binary floats first, then decimal places; null for n = 0."""
    n, z = F.nullif(n, F.lit(0)).cast("double"), F.lit(z)
    p = k.cast("double") / n
    scale = F.lit(1.0) + (z * z) / n
    centre = (p + (z * z) / (F.lit(2.0) * n)) / scale
    spread = (z / scale) * F.sqrt((p * (F.lit(1.0) - p)) / n + (z * z) / (F.lit(4.0) * n * n))
    end = F.when(upper, centre + spread).otherwise(centre - spread)
    return _to_fixed(p), _to_fixed(F.when(n.isNotNull(), F.least(F.lit(1.0), F.greatest(F.lit(0.0), end))))
