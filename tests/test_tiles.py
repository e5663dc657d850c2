"""Operators on tiles give what the kernels of one view give, wherever the tiles' borders lie."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterloom.operators import kernels, tiles
from rasterloom.operators.components import roots

SHAPE = (61, 74)


def winding():
    """A line that crosses tiles many times, with one strong pixel at its end, and chance pixels."""
    rng = np.random.default_rng(6)
    v = np.where(rng.random(SHAPE) < 0.25, 5, 0)
    for k in range(0, SHAPE[0] - 1, 4):
        v[k] = 5
        v[k : k + 4, -1 if k % 8 == 0 else 0] = 5
        v[k + 1 : k + 4, 1:-1] = 0
    v[0, 0] = 9
    v[30, 40] = 9
    return v


def islands():
    return np.random.default_rng(7).choice([0, 5, 9], SHAPE, p=[0.68, 0.28, 0.04])


def table(spark, *images):
    return spark.createDataFrame([(k, r, c, int(v[r, c])) for k, v in enumerate(images) for r in range(v.shape[0]) for c in range(v.shape[1])], "img_id long, r int, c int, g int").repartition(6)


def found(df):
    return {tuple(r) for r in df.select("img_id", "r", "c").collect()}


def want(kernel, *images):
    return {(k, int(r), int(c)) for k, v in enumerate(images) for r, c in zip(*np.nonzero(kernel(v)))}


@pytest.mark.parametrize("size", [16, 19])
def test_hysteresis(spark, size):
    images = winding(), islands(), np.zeros((3, 3), int)
    got = found(tiles.hysteresis(table(spark, *images), "g", 5, 9, size))
    assert got == want(lambda v: kernels.hysteresis(v, 5, 9), *images) and len(got) > 400


@pytest.mark.parametrize("size,halo", [(16, 2), (16, 8), (40, 16)])
def test_thinning(spark, size, halo):
    blob = np.zeros(SHAPE, int)
    blob[5:55, 8:70] = 1  # thicker than any halo
    blob[20:30, 30:44] = 0
    images = blob, (islands() > 0).astype(int), np.zeros((3, 3), int)
    assert found(tiles.thin(table(spark, *images).where("g > 0"), size, halo)) == want(kernels.thin, *images)


@pytest.mark.parametrize("size", [5, 16])
def test_distance(spark, size):
    few = np.zeros(SHAPE, int)
    few[3, 70] = few[58, 2] = 1
    images = few, (islands() > 8).astype(int), np.zeros((7, 4), int)
    got = {tuple(r)[:3]: r["value"] for r in tiles.distance(table(spark, *images), "g", size).collect()}
    for k, v in enumerate(images):
        exact = kernels.distance(v)
        assert all(got[k, r, c] == pytest.approx(exact[r, c], abs=1e-9) for r in range(v.shape[0]) for c in range(v.shape[1]))


def test_no_group_is_larger_than_a_tile(spark):
    px = table(spark, winding())
    packed = tiles.pack(px, "g", 16).collect()
    assert len(packed) == 4 * 5 and all(len(r["data"]) == 16 * 16 * 8 for r in packed)


def test_envelope():
    rng = np.random.default_rng(1)
    for _ in range(200):
        n = int(rng.integers(1, 30))
        square = np.where(rng.random(n) < 0.5, np.inf, rng.integers(0, 12, n) ** 2.0)
        x = np.arange(n)
        assert np.array_equal(tiles.envelope(square), (square[None] + (x[:, None] - x[None]) ** 2).min(1))


def test_roots(spark):
    rng = np.random.default_rng(3)
    edges = [(int(i), int(a), int(b)) for i, a, b in zip(rng.integers(0, 2, 90), rng.integers(0, 120, 90), rng.integers(0, 120, 90))]
    edges += [(3, k, k + 1) for k in range(200)] + [(4, 500, k) for k in range(50)] + [(5, 7, 7)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for i, a, b in edges:
        a, b = sorted((find((i, a)), find((i, b))))
        parent[b] = a
    got = {(r["img_id"], r["node"]): r["root"] for r in roots(spark.createDataFrame(edges, "img_id long, u long, v long")).collect()}
    assert got == {(i, n): find((i, n))[1] for i, n in parent if (i, n) != (5, 7)}
    assert roots(spark.createDataFrame([], "img_id long, u long, v long")).count() == 0


def test_whole_image_query(spark):
    from rasterloom.plans.rasters import tiled_thin, whole_gray

    px = whole_gray(spark, "/root/testdata/sf0.001").where("g > 150").collect()
    on = np.zeros((max(r["r"] for r in px) + 1, 64), bool)
    for r in px:
        on[r["r"], r["c"]] = True
    assert found(tiled_thin(spark, "/root/testdata/sf0.001")) == {(0, int(r), int(c)) for r, c in zip(*np.nonzero(kernels.thin(on)))}


def test_distance_looks_only_so_many_rows_away(spark):
    v = np.zeros((90, 20), int)
    v[3, 2], v[9, 17] = 9, 9
    r, c = np.indices(v.shape)
    far = np.full(v.shape, np.inf)
    for a, b in np.argwhere(v):
        far = np.where(abs(r - a) <= 40, np.minimum(far, np.hypot(r - a, c - b)), far)
    got = {(q.r, q.c): q.value for q in tiles.distance(table(spark, v), "g", 16, 40).collect()}
    assert set(got) == {(int(a), int(b)) for a, b in np.argwhere(np.isfinite(far))}
    assert all(abs(got[at] - far[at]) < 1e-9 for at in got)
