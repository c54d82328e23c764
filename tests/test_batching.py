"""Packing by many tasks against one greedy pass."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyspan.operators import batching, generate


def greedy(units, most, load=0, batch=0):
    out = []
    for u in units:
        if load and load + u > most:
            batch, load = batch + 1, 0
        load += u
        out.append(batch)
    return out, load, batch


@pytest.mark.parametrize("most", [1, 7, 32])
def test_functions_of_parts(most):
    r = random.Random(most)
    for _ in range(60):
        units = np.array([r.choice([1, 1, 2, 5, most, most + 3]) for _ in range(r.randrange(1, 40))])
        opened, left = batching.function(units, most)
        for load in range(most + 2):
            _, end, batch = greedy(units, most, load)
            assert (opened[load], left[load]) == (batch, min(end, most + 1))
            assert batching._assigned(units, most, load, 5).tolist() == greedy(units, most, load, 5)[0]


@pytest.mark.parametrize("part_rows", [1, 13, 1 << 17])
def test_batches_do_not_depend_on_parts(spark, part_rows):
    r = random.Random(1)
    cases = [(i, r.choice([0, 1, 3, 40, 9])) for i in range(60 if part_rows == 1 else 400)] + [(None, 2), (7, 3), (7, 1)]
    df = spark.createDataFrame(cases, "case_id long, variants int").repartition(5)
    rows = batching.packed(df, "case_id", F.col("variants"), 32, part_rows).collect()
    want = sorted(((-1 if i is None else i, max(1, v)) for i, v in cases))
    got = sorted((-1 if x.case_id is None else x.case_id, x.units, x.batch) for x in rows)
    assert [g[:2] for g in got] == want and [g[2] for g in got] == greedy([u for _, u in want], 32)[0]


def test_no_cases(spark):
    assert generate.batches(spark.createDataFrame([], "case_id long, variants int")).count() == 0
