"""Embedding near-duplicates: spherical k-means cells, blocked cosine products within cells, one kept vector a group.

Equal vectors of a label are grouped first and stand for their group. Centres are fitted by spherical k-means on a hash-chosen
sample of at most ``SAMPLE`` vectors. A vector's home is the cell of its most similar centre. Similar vectors can have
different homes: if y lies within angle t of x, where cos t = threshold, and has home c, then y . (u_c - u_home) >= 0, so
x . (u_home - u_c) <= sin t * |u_home - u_c|. So x also visits every cell c that meets this, and all its links are
found among the homes of the cells it visits; each link counts once for x, as y has one home. How many cells that
are depends on the vectors: few where they cluster, most where they lie evenly in many dimensions. As only equal
labels compare, the number of cells follows the largest label, so that visits stay few against a cell's rows.

A cell's homes are dealt into blocks of at most about ``BLOCK`` rows and its visitors into blocks as well; each pair of
blocks is one product of bounded size. From every product only the number of links of each visitor and a spanning
forest of its links go on.

Defined results: vectors that are null, empty, zero or hold a null or non-finite component, and rows with a null label, have no
links and are their own component; equal vectors link; vectors of different lengths never link; rows that
repeat a vec_id count as vectors of their own; empty tables give no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import components, cut, salted, workspace

#: Vectors that centres are fitted on, vectors of one label that a cell aims at, fewest and most cells, and rows of a block.
SAMPLE, CELL, LEAST_CELLS, CELLS, BLOCK = 20_000, 1024, 8, 2048, 1024


def fit_centres(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means of unit rows, begun at rows far from each other."""
    k = max(1, min(k, len(x)))
    chosen = [0]
    best = x @ x[0]
    for _ in range(k - 1):
        chosen.append(int(best.argmin()))
        best = np.maximum(best, x @ x[chosen[-1]])
    centres = x[chosen].copy()
    for _ in range(rounds):
        cell = (x @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, cell, x)
        norm = np.linalg.norm(sums, axis=1)
        centres = np.where(norm[:, None] > 1e-12, sums / np.maximum(norm, 1e-12)[:, None], centres)
    return centres


def _scaled(vectors: list[bytes]) -> np.ndarray:
    """Rows divided by a power of two near their largest component: their cosines stay the same, and squares of very large or small components are not lost."""
    x = np.frombuffer(b"".join(vectors), dtype="<f8").reshape(len(vectors), -1)
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])


def _unit(vectors: list[bytes]) -> np.ndarray:
    """Rows of length one."""
    x = _scaled(vectors)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _assign(centres: dict[int, np.ndarray], threshold: float):
    """Home and visited cells of each vector."""
    reach = (1 - threshold**2) ** 0.5 + 1e-9 if threshold > 0 else 3.0
    apart = {d: np.linalg.norm(c[:, None, :] - c[None, :, :], axis=2) for d, c in centres.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch["dim"].to_numpy()
            for d in np.unique(dims).tolist():
                own = np.flatnonzero(dims == d)
                rows = batch.take(pa.array(own))
                dot = _unit(rows["vector"].to_pylist()) @ centres[d].T if d in centres else np.zeros((len(own), 1))
                home = dot.argmax(axis=1)
                gap = dot[np.arange(len(own)), home][:, None] - dot
                visit = gap <= reach * apart[d][home] if d in centres else np.ones((len(own), 1), bool)
                visit[np.arange(len(own)), home] = True
                cells = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(visit.sum(axis=1))]).astype(np.int32)), pa.array(np.nonzero(visit)[1].astype(np.int32)))
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(home.astype(np.int32)), cells], names=[*rows.schema.names, "home", "cells"])

    return run


def _forest(linked: np.ndarray, visitors: np.ndarray, homes: np.ndarray) -> list[tuple[int, int]]:
    """Links (visitor, home) that connect what the matrix of links connects."""
    left, free, out = linked.any(axis=1), linked.any(axis=0), []
    for start in np.flatnonzero(left):
        todo = [start] if left[start] else []
        left[start] = False
        while todo:
            i = todo.pop()
            fresh = np.flatnonzero(linked[i] & free)
            free[fresh] = False
            for j in fresh:
                out.append((visitors[i], homes[j]))
                more = np.flatnonzero(linked[:, j] & left)
                left[more] = False
                out += [(visitors[m], homes[j]) for m in more]
                todo += more.tolist()
    return out


def _compare(threshold: float):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        at_home = pdf["at_home"].to_numpy()
        home, guest = pdf[at_home], pdf[~at_home]
        if not len(home) or not len(guest):
            return pd.DataFrame({"id": [], "n": [], "other": []}, dtype="int64")
        x, y = (_scaled(list(p["vector"])) for p in (guest, home))
        dot = x @ y.T
        dot /= np.outer(np.linalg.norm(x, axis=1), np.linalg.norm(y, axis=1))
        a, b = guest["id"].to_numpy(), home["id"].to_numpy()
        linked = (dot >= threshold) & (a[:, None] != b[None, :])
        n = linked @ home["copies"].to_numpy()
        pairs = np.array(_forest(linked, a, b), dtype=np.int64).reshape(-1, 2)
        some = n > 0
        return pd.DataFrame({"id": np.concatenate([a[some], pairs[:, 0]]), "n": np.concatenate([n[some], np.zeros(len(pairs), dtype=np.int64)]), "other": np.concatenate([a[some], pairs[:, 1]])})

    return run


def _vector(col: Column) -> Column:
    """The vector, or null where it cannot link."""
    v = col.cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(v.isNotNull() & (F.size(v) > 0) & ~bad & F.exists(v, lambda x: x != 0), v)


def near_duplicates(vectors: DataFrame, threshold: float = 0.93, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(id_col, n_links, component_id, kept) for each row: links join equal labels with cosine >= threshold.

    The rows are computed at once and stand as a table in the shared folder; the working tables are deleted.
    """
    spark = vectors.sparkSession
    with workspace(spark) as folder:
        return cut(_near(vectors, threshold, id_col, vector_col, label_col, folder))


def _near(vectors: DataFrame, threshold: float, id_col: str, vector_col: str, label_col: str, folder: str) -> DataFrame:
    rows = vectors.select(F.col(id_col).cast("long").alias("vec"), F.when(F.col(label_col).isNotNull(), _vector(F.col(vector_col))).alias("v"), F.col(label_col).cast("string").alias("label"))
    good = rows.where("v is not null and vec is not null").select("vec", F.struct("label", "v").alias("key"))
    groups = good.groupBy("key").agg(F.min("vec").alias("least"), F.count("*").alias("copies"))
    # Rows may repeat a vec_id with another vector, so groups have numbers of their own.
    groups = cut(groups.select(F.monotonically_increasing_id().alias("id"), "key", "key.label", "key.v", "least", "copies"), folder)

    def bytes_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            packed = [np.asarray(v, dtype="<f8").tobytes() for v in b["v"].to_pylist()]
            yield pa.RecordBatch.from_arrays([b["id"], b["copies"], b["label"], pa.array([len(p) // 8 for p in packed], pa.int32()), pa.array(packed, pa.binary())], names=["id", "copies", "label", "dim", "vector"])

    packed = groups.select("id", "copies", "label", "v").mapInArrow(bytes_of, "id long, copies long, label string, dim int, vector binary")
    total = groups.count()
    largest = groups.groupBy("label", F.size("v")).count().agg(F.max("count")).first()[0] or 0
    k = min(CELLS, max(LEAST_CELLS, -(-largest // CELL)))
    draw = F.pmod(F.xxhash64("id", F.lit(31)), F.lit(1 << 30)) / float(1 << 30)
    sample = packed.where(draw < min(1.0, SAMPLE / max(1, total))).select("dim", "vector").collect()
    sample.sort(key=lambda r: bytes(r["vector"]))
    centres = {d: fit_centres(_unit([r["vector"] for r in sample if r["dim"] == d]), k) for d in {r["dim"] for r in sample}}

    placed = packed.mapInArrow(_assign(centres, threshold), "id long, copies long, label string, dim int, vector binary, home int, cells array<int>")
    placed = cut(placed, folder)
    sizes = placed.groupBy("label", "dim", F.col("home").alias("cell")).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("home_parts"))
    visits = placed.select("*", F.explode("cells").alias("cell")).drop("cells")
    counts = visits.groupBy("label", "dim", "cell").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("guest_parts"))
    parts = cut(sizes.join(counts, ["label", "dim", "cell"]), folder)
    key = ["label", "dim", "cell"]
    deal = lambda n: F.pmod(F.xxhash64("id", F.lit(5)), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    cols = [*key, "home_part", "guest_part", "at_home", "id", "copies", "vector"]
    guests = visits.join(parts, key).withColumn("guest_part", deal("guest_parts")).withColumn("home_part", every("home_parts")).withColumn("at_home", F.lit(False))
    homes = placed.withColumn("cell", F.col("home")).join(parts, key).withColumn("home_part", deal("home_parts")).withColumn("guest_part", every("guest_parts")).withColumn("at_home", F.lit(True))
    met = guests.select(*cols).union(homes.select(*cols)).groupBy(*key, "home_part", "guest_part")
    found = cut(met.applyInPandas(_compare(threshold), "id long, n long, other long"), folder)
    labels = components(found.where("id <> other").select(F.col("id").alias("a"), F.col("other").alias("b")), folder)
    linked = found.groupBy("id").agg(F.sum("n").alias("n"))
    head = groups.join(linked, "id", "left").join(labels.select(F.col("node").alias("id"), F.col("label").alias("found")), "id", "left").withColumn("label", F.coalesce("found", "id"))
    head = cut(head.select("key", "label", "least", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links")), folder)
    least = head.groupBy("label").agg(F.min("least").alias("component_id"))
    head = salted(head, least, "label").select("key", "n_links", "component_id")
    done = salted(good, head, "key").select("vec", "n_links", "component_id")
    alone = rows.where("v is null or vec is null").select("vec", F.lit(0).cast("long").alias("n_links"), F.col("vec").alias("component_id"))
    out = done.union(alone)
    return out.select(F.col("vec").alias(id_col), F.col("n_links").cast("long").alias("n_links"), "component_id", F.coalesce(F.col("vec") == F.col("component_id"), F.lit(True)).alias("kept"))
