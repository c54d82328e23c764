"""Greedy packing of a whole run, in order, by many tasks at once.

The run is cut into parts that follow each other. What a part does to the batch that is open when it begins is a function: for each load
from 0 to the limit, how many batches it opens and what load it leaves. It is found for all loads together: where the first batch ends
depends on the load, and from there on each batch's end is the same for all, looked up in the part's running sums. The functions are composed in
two levels: those of a group of parts in one task, then the groups' on the driver, which holds one small table for each of about
sqrt(parts) groups. So the result doesn't depend on the parts, and is what one pass over the run would give.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources import staging

#: Rows of a part, on average.
PART_ROWS = 1 << 17


def _steps(units: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Running sums with a 0 before them, and for each row the first row after the batch that begins at it."""
    total = np.concatenate([[0], np.cumsum(units)])
    after = np.searchsorted(total, total[:-1] + most, "right") - 1
    return total, np.maximum(after, np.arange(1, len(total)))  # a row heavier than a batch stands alone


def _first_end(total: np.ndarray, most: int, load: np.ndarray) -> np.ndarray:
    """For each load the first row that doesn't fit the open batch; an empty batch takes any row."""
    end = np.maximum(np.searchsorted(total, most - load, "right") - 1, 0)
    return np.where(load == 0, np.maximum(end, min(1, len(total) - 1)), end)


def function(units: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """For each load 0 to most (and one more, for a batch that a heavy row filled): the number of batches opened, and the load left."""
    load = np.arange(most + 2)
    total, after = _steps(units, most)
    n, at, opened, begin = len(units), _first_end(total, most, load), np.zeros(most + 2, np.int64), np.full(most + 2, -1)
    while (on := at < n).any():
        opened[on] += 1
        begin[on] = at[on]
        at[on] = after[at[on]]
    left = np.where(begin < 0, load + total[-1], total[-1] - total[np.maximum(begin, 0)])
    return opened, np.minimum(left, most + 1)


def _assigned(units: np.ndarray, most: int, load: int, batch: int) -> np.ndarray:
    """Each row's batch, for a part that is entered with an open batch."""
    total, after = _steps(units, most)
    n, at, starts = len(units), int(_first_end(total, most, np.array([load]))[0]), []
    while at < n:
        starts.append(at)
        at = int(after[at])
    fresh = np.zeros(n, np.int64)
    fresh[starts] = 1
    return batch + np.cumsum(fresh)


def _composed(tables: list[tuple[np.ndarray, np.ndarray]], size: int) -> tuple[np.ndarray, np.ndarray]:
    opened, load = np.zeros(size, np.int64), np.arange(size)
    for more, left in tables:
        opened, load = opened + more[load], left[load]
    return opened, load


def _read(table: pa.Table) -> list[tuple[np.ndarray, np.ndarray]]:
    return [(np.frombuffer(o, np.int64), np.frombuffer(l, np.int64)) for o, l in zip(table["opened"].to_pylist(), table["left"].to_pylist())]


def packed(rows: DataFrame, order: str, units: Column, most: int, part_rows: int = PART_ROWS) -> DataFrame:
    """(order, units, batch): the rows in order, batches of at most ``most`` units, each as full as the next row allows.

    units are at least 1; a row of more than ``most`` stands alone in its batch. Batches count from 0. Rows that repeat an order are taken by
    rising units; rows without an order come first. The rows are computed now and kept in the shared folder; no rows give no rows.
    """
    spark = rows.sparkSession
    table = rows.select(F.col(order), F.greatest(units, F.lit(1)).cast("long").alias("units"))
    parts = max(1, -(-table.count() // part_rows))
    table = staging.kept(table.repartitionByRange(parts, F.asc_nulls_first(order), "units").withColumn("part", F.spark_partition_id()), "run")
    group, size = max(1, int(parts**0.5)), most + 2
    sort = lambda t: t.sort_by([(order, "ascending"), ("units", "ascending")])

    def sorted_units(t: pa.Table) -> tuple[pa.Table, np.ndarray]:
        t = pa.concat_tables([t.filter(pa.compute.is_null(t[order])).sort_by("units"), sort(t.filter(pa.compute.is_valid(t[order])))])
        return t, t["units"].to_numpy()

    def summary(t: pa.Table) -> pa.Table:
        opened, left = function(sorted_units(t)[1], most)
        return pa.table({"part": t["part"][:1], "opened": pa.array([opened.tobytes()], pa.binary()), "left": pa.array([left.tobytes()], pa.binary())})

    functions = staging.kept(table.groupBy("part").applyInArrow(summary, "part int, opened binary, left binary").withColumn("of", (F.col("part") / group).cast("int")), "run")

    def composed(t: pa.Table) -> pa.Table:
        opened, left = _composed(_read(t.sort_by("part")), size)
        return pa.table({"of": t["of"][:1], "opened": pa.array([opened.tobytes()], pa.binary()), "left": pa.array([left.tobytes()], pa.binary())})

    load, batch, entries = 0, 0, []
    groups = functions.groupBy("of").applyInArrow(composed, "of int, opened binary, left binary").orderBy("of").collect()
    for r in groups:
        entries.append((r["of"], load, batch))
        opened, left = np.frombuffer(r["opened"], np.int64), np.frombuffer(r["left"], np.int64)
        load, batch = int(left[load]), batch + int(opened[load])

    def entered(t: pa.Table) -> pa.Table:
        t = t.sort_by("part")
        load, batch, out = t["load"][0].as_py(), t["batch"][0].as_py(), []
        for opened, left in _read(t):
            out.append((load, batch))
            load, batch = int(left[load]), batch + int(opened[load])
        return pa.table({"part": t["part"], "load": pa.array([o[0] for o in out], pa.int32()), "batch": pa.array([o[1] for o in out], pa.int64())})

    begun = functions.join(spark.createDataFrame(entries, "of int, load int, batch long"), "of").groupBy("of").applyInArrow(entered, "part int, load int, batch long")

    def numbered(t: pa.Table, entry: pa.Table) -> pa.Table:
        t, u = sorted_units(t)
        row = entry.slice(0, 1).to_pylist()[0]
        return pa.table({order: t[order], "units": t["units"], "batch": pa.array(_assigned(u, most, row["load"], row["batch"]), pa.int64())})

    kind = table.schema[order].dataType.simpleString()
    return table.groupBy("part").cogroup(begun.groupBy("part")).applyInArrow(numbered, f"`{order}` {kind}, units long, batch long")
