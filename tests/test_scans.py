"""Folds over sessions against plain loops, their growth, and numbers without gaps."""

from __future__ import annotations

import math
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterloom.operators import scans
from rasterloom.operators.numbering import number_rows


def walk(n, seed=1):
    return np.random.default_rng(seed).normal(0, 12, (n, 2)).cumsum(0)


@pytest.mark.parametrize("n", [0, 1, 2, 63, 64, 65, 66, 500])
def test_against_loops(n):
    xy = walk(n)
    smooth, gate, space = [], [], []
    for k, (x, y) in enumerate(xy.tolist()):
        smooth.append((0.7 * smooth[-1][0] + 0.3 * x, 0.7 * smooth[-1][1] + 0.3 * y) if smooth else (x, y))
        if not gate or math.dist(xy[gate[-1]], (x, y)) >= 30:
            gate.append(k)
        if all(math.dist(xy[q], (x, y)) >= 30 for q in space):
            space.append(k)
    assert np.allclose(scans.smoothed(xy), np.array(smooth).reshape(-1, 2), atol=1e-9)
    assert scans.gated(xy, 30).tolist() == gate and scans.spaced(xy, 30).tolist() == space


def test_time_grows_with_the_events():
    for fold in (lambda xy: scans.smoothed(xy), lambda xy: scans.gated(xy, 30.0), lambda xy: scans.spaced(xy, 30.0)):
        took = []
        for n in (20_000, 200_000):
            xy, start = walk(n), time.perf_counter()
            fold(xy)
            took.append(time.perf_counter() - start)
        assert took[1] < 40 * took[0] + 0.5


def test_gate_that_never_opens_looks_once():
    assert scans.gated(np.zeros((300_000, 2)), 1.0).tolist() == [0]


def test_numbers_of_one_large_key(spark):
    rng = np.random.default_rng(5)
    rows = [(1, int(k)) for k in rng.permutation(5000)] + [(2, 9), (2, 3), (None, 4), (None, 1)]
    out = number_rows(spark.createDataFrame(rows, "layer long, fid long"), "layer", "fid", "n")
    got = out.withColumn("task", F.spark_partition_id()).collect()
    assert {(r["layer"], r["fid"]): r["n"] for r in got} == {**{(1, k): k + 1 for k in range(5000)}, (2, 3): 1, (2, 9): 2, (None, 1): 1, (None, 4): 2}
    assert number_rows(spark.createDataFrame([], "layer long, fid long"), "layer", "fid").count() == 0


def test_one_large_key_is_several_tasks(spark):
    df = spark.range(0, 20_000).select(F.lit(7).alias("layer"), F.col("id").alias("fid"))
    parts = df.repartitionByRange(8, "layer", "fid").groupBy(F.spark_partition_id()).count().collect()
    assert len(parts) == 8 and max(r["count"] for r in parts) < 10_000
    assert number_rows(df, "layer", "fid").where("number <> fid + 1").count() == 0
