"""Embedding whitening from an exact scatter in residue numbers.

Components become integers x = floor(scale * c) + offset. The fit list holds each different x once. Its scatter is summed
in residues: each task multiplies its vectors, with a one before each, modulo several primes, as double GEMMs whose sums stay
below 2^53; the products' residues are added up by Spark and turned into exact integers by Chinese remaindering. So n, the
sums S and all products come out exact from one pass, whatever the order of tasks, and the covariance (n Q - S S') / n^2 is
centred in integers before it is rounded once. Its eigenvectors are found in double precision on the driver, as it has as
many rows as a vector has components, whatever the number of vectors.

As many primes are used as the bound n * max|x|^2 needs.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from itertools import count, islice
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, slices, workspace

#: Primes lie below this, so residues are at most half of it, and ROWS products of two fit a double.
PRIMES_BELOW, ROWS = 1 << 21, 1 << 12
#: Rows of the scatter that travel together, and tasks whose sums meet first.
STRIP, FAN = 64, 64


def primes(n: int) -> list[int]:
    """The n largest primes below PRIMES_BELOW."""
    odd = (PRIMES_BELOW - 1 - 2 * k for k in count())
    return list(islice((p for p in odd if all(p % q for q in range(3, int(p**0.5) + 1, 2))), n))


def _centred(x: np.ndarray, p: int) -> np.ndarray:
    """Residues between -p/2 and p/2."""
    r = x % p
    return np.where(r > p // 2, r - p, r).astype(np.float64)


def modular_scatter(x: np.ndarray, p: int) -> np.ndarray:
    """x' x modulo p."""
    total = np.zeros((x.shape[1], x.shape[1]), np.int64)
    for a in range(0, len(x), ROWS):
        r = _centred(x[a : a + ROWS], p)
        total = (total + (r.T @ r).astype(np.int64)) % p
    return total


def _matrix(col: pa.Array) -> np.ndarray:
    """The rows of a column of equally long arrays of long."""
    return col.flatten().to_numpy(zero_copy_only=False).reshape(len(col), -1)


def _scatters(moduli: list[int]):
    """For each dimension, prime and strip of rows the residues that a task sums up: (dim, prime, strip, task, sums)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        sums: dict[int, list[np.ndarray]] = {}
        for batch in slices(batches, ROWS):
            dims = batch["dim"].to_numpy()
            for d in np.unique(dims).tolist():
                x = _matrix(batch["x"].filter(pa.array(dims == d)))
                x = np.concatenate([np.ones((len(x), 1), np.int64), x], axis=1)
                now = [modular_scatter(x, p) for p in moduli]
                sums[d] = [(a + b) % p for a, b, p in zip(sums[d], now, moduli)] if d in sums else now
        for d, found in sums.items():
            for k, total in enumerate(found):
                cuts = range(0, d + 1, STRIP)
                strips = [total[a : a + STRIP].tobytes() for a in cuts]
                n, task = len(strips), TaskContext.get().partitionId() % FAN
                cols = [pa.array([d] * n, pa.int32()), pa.array([k] * n, pa.int32()), pa.array(range(n), pa.int32()), pa.array([task] * n, pa.int32()), pa.array(strips, pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, names=["dim", "prime", "strip", "task", "sums"])

    return run


def _added(moduli: list[int]):
    """One row with the sum of a group's residues."""

    def run(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, last = None, None
        for batch in slices(tables, 16):
            for row in batch["sums"].to_pylist():
                now, p = np.frombuffer(row, np.int64), moduli[batch["prime"][0].as_py()]
                total = now if total is None else (total + now) % p
            last = batch.slice(0, 1) if len(batch) else last
        if last is not None:
            yield last.set_column(last.schema.get_field_index("sums"), "sums", pa.array([total.tobytes()], pa.binary()))

    return run


def exact_scatters(fit: DataFrame) -> dict[int, list[list[int]]]:
    """For each dimension d of fit (dim, x) the exact products of (1, x) with itself, d + 1 by d + 1."""
    sizes = fit.groupBy("dim").agg(F.count("*").alias("n"), F.max(F.array_max(F.transform("x", F.abs))).alias("most")).collect()
    if not sizes:
        return {}
    bound = max(2 * r.n * max(1, r.most) ** 2 + 1 for r in sizes)
    moduli = primes(-(-bound.bit_length() // (PRIMES_BELOW.bit_length() - 2)))
    schema = "dim int, prime int, strip int, task int, sums binary"
    parts = fit.mapInArrow(_scatters(moduli), schema)
    parts = parts.groupBy("dim", "prime", "strip", "task").applyInArrow(_added(moduli), schema)
    parts = parts.groupBy("dim", "prime", "strip").applyInArrow(_added(moduli), schema)
    found = {(r.dim, r.prime, r.strip): np.frombuffer(r.sums, np.int64) for r in parts.collect()}
    product = int(np.prod(np.array(moduli, dtype=object)))
    unit = [product // p * pow(product // p, -1, p) for p in moduli]
    out = {}
    for d in (r.dim for r in sizes):
        whole = [np.concatenate([found[d, k, s] for s in range(-(-(d + 1) // STRIP))]).astype(object) for k in range(len(moduli))]
        value = sum(w * u for w, u in zip(whole, unit)) % product
        value = np.where(value > product // 2, value - product, value)
        out[d] = value.reshape(d + 1, d + 1).tolist()
    return out


class Whitener(NamedTuple):
    """n and sums of a fit list, and by component the unit eigenvectors, roots of eigenvalues and their parts of the whole."""

    n: int
    sums: list[int]
    vectors: np.ndarray
    roots: np.ndarray
    explained: np.ndarray


def whitener(scatter: list[list[int]], components: int) -> Whitener:
    """Components with an eigenvalue that cannot be told from zero are left out."""
    n, sums = scatter[0][0], scatter[0][1:]
    exact = [[n * q - a * b for q, b in zip(row[1:], sums)] for row, a in zip(scatter[1:], sums)]
    covariance = np.array([[v / (n * n) for v in row] for row in exact], dtype=np.float64)
    e, v = np.linalg.eigh(covariance)
    trace = float(Fraction(sum(exact[i][i] for i in range(len(sums))), n * n))
    order = np.argsort(-e, kind="stable")[:components]
    order = order[e[order] > len(sums) * np.finfo(float).eps * trace]
    return Whitener(n, sums, v[:, order], np.sqrt(e[order]), e[order] / trace if trace else e[order])


def _deviations(x: np.ndarray, fit: Whitener) -> tuple[np.ndarray, list[int]]:
    """n x - S as doubles divided by n, and the exact sums of squares."""
    most = fit.n * int(np.abs(x).max(initial=0)) + max(map(abs, fit.sums))
    kind = np.int64 if most < 2**62 else object
    apart = fit.n * x.astype(kind) - np.array(fit.sums, dtype=kind)
    small = len(fit.sums) * int(np.abs(apart).max(initial=0)) ** 2 < 2**63
    exact = apart.astype(np.int64 if small else object)
    return (apart / fit.n).astype(np.float64), (exact * exact).sum(axis=1).tolist()


def _whitened(fits: dict[int, Whitener], errors: dict[int, float]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1024):
            dims = batch["dim"].to_numpy()
            for d in np.unique(dims).tolist():
                rows, fit = batch.filter(pa.array(dims == d)), fits[d]
                apart, squares = _deviations(_matrix(rows["x"]), fit)
                m, k = len(rows), len(fit.roots)
                lists = lambda values: pa.ListArray.from_arrays(pa.array(np.arange(m + 1, dtype=np.int32) * k), pa.array(values.ravel()))
                same = lambda v, t: pa.array([v] * m, t)
                cols = [rows["vec"], same(fit.n, pa.int64()), pa.array(list(map(str, squares))), lists(apart @ fit.vectors / fit.roots), lists(np.tile(fit.explained, (m, 1))), same(errors.get(d), pa.float64())]
                yield pa.RecordBatch.from_arrays(cols, names=["vec", "n", "deviation", "whitened", "explained", "identity_error"])

    return run


_SCHEMA = "n long, deviation string, whitened array<double>, explained array<double>, identity_error double"


def _moments(fits: dict[int, Whitener]):
    """A task's sums of the products of centred whitened components: (dim, i, j, total)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {d: np.zeros((len(f.roots), len(f.roots))) for d, f in fits.items()}
        for batch in slices(batches, ROWS):
            dims = batch["dim"].to_numpy()
            for d in np.unique(dims).tolist():
                w = _deviations(_matrix(batch["x"].filter(pa.array(dims == d))), fits[d])[0] @ fits[d].vectors / fits[d].roots
                sums[d] += w.T @ w
        for d, total in sums.items():
            i, j = np.indices(total.shape)
            cols = [pa.array(np.full(total.size, d, np.int32)), pa.array(i.ravel().astype(np.int32)), pa.array(j.ravel().astype(np.int32)), pa.array(total.ravel())]
            yield pa.RecordBatch.from_arrays(cols, names=["dim", "i", "j", "total"])

    return run


def integers(vector: Column, scale: int, offset: int) -> Column:
    """floor(scale * c) + offset of each entry c as a double; null where the vector is null or an entry is null, not finite or beyond 2^52 / scale."""
    v = vector.cast("array<double>")
    bad = F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) > (1 << 52) / scale))
    return F.when(v.isNotNull() & ~bad, F.transform(v, lambda c: F.floor(c * F.lit(float(scale))).cast("long") + F.lit(offset).cast("long")))


def whiten(vectors: DataFrame, components: int = 16, scale: int = 64, offset: int = 1_000_000, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id_col, n, deviation, whitened, explained, identity_error) for each row whose vector can be used.

    whitened and explained hold an entry for each component, by falling eigenvalue. deviation is the exact sum of (n x - S)^2 in digits.
    identity_error is the largest entry of |covariance of whitened - identity| over the fit list. Rows whose vector is null, or has an entry
    that is null, not finite or too large for ``integers``, are dropped, as are empty vectors. Vectors of different lengths have fit lists
    of their own. Rows that repeat a vector count once in the fit list and are all returned; ids may be null or repeated.
    Where a fit list varies in fewer directions, there are fewer components; one vector alone has none. Extra columns are ignored.

    The fit list is computed at once, as a table that is deleted; the rows are lazy.
    """
    rows = vectors.select(F.col(id_col).alias("vec"), integers(F.col(vector_col), scale, offset).alias("x")).where("x is not null and size(x) > 0")
    rows = rows.select("vec", F.size("x").alias("dim"), "x")
    with workspace(vectors.sparkSession) as folder:
        fit = cut(rows.groupBy("dim", "x").agg(F.lit(1).alias("one")).select("dim", "x"), folder)
        fits = {d: whitener(s, components) for d, s in exact_scatters(fit).items()}
        sums = fit.mapInArrow(_moments(fits), "dim int, i int, j int, total double").groupBy("dim", "i", "j").agg(F.sum("total").alias("total")).collect()
    errors: dict[int, float] = {}
    for r in sums:
        errors[r.dim] = max(errors.get(r.dim, 0.0), abs(r.total / fits[r.dim].n - (r.i == r.j)))
    kind = vectors.schema[id_col].dataType.simpleString()
    out = rows.mapInArrow(_whitened(fits, errors), f"vec {kind}, {_SCHEMA}")
    return out.withColumnRenamed("vec", id_col)
