"""Whitening against an eigendecomposition in plain NumPy and exact whole numbers in Python."""

from __future__ import annotations

import math

import numpy as np
import pytest

from rasterloom.llm import whitening as w

SCHEMA = "vec_id long, embedding array<float>, label int, component int, x string, i int, v int"


def table(spark, vectors, parts=3):
    return spark.createDataFrame([(i, v, 1, 2, "y", 3, 4) for i, v in vectors], SCHEMA).repartition(parts)


def plainly(vectors, most=32):
    good = [(i, v) for i, v in vectors if v and all(c is not None and math.isfinite(c) for c in v)]
    x = [[math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for _, v in good]
    n, sums = len(x), [sum(c) for c in zip(*x)]
    far = [sum((n * a - s) ** 2 for a, s in zip(r, sums)) for r in x]
    centred = np.array([[(n * a - s) / n for a, s in zip(r, sums)] for r in x])
    cov = centred.T @ centred / n
    e, u = np.linalg.eigh(cov)
    e, u = e[::-1][:most], u[:, ::-1][:, :most]
    return good, n, far, centred @ u / np.sqrt(e), e / np.trace(cov)


def held_to(rows, vectors, most=32):
    good, n, far, white, explained = plainly(vectors, most)
    assert len(rows) == len(good) * len(explained)
    by = {}
    for r in rows:
        by.setdefault((r["vec_id"], r["component"]), []).append(r)
    for c in range(len(explained)):
        sign = None
        for k, (i, _) in enumerate(good):
            r = by[i, c + 1][0]
            sign = sign or (1 if r["whitened"] * white[k, c] > 0 else -1)
            assert r["whitened"] == pytest.approx(sign * white[k, c], abs=1e-6)
            assert (r["n"], r["deviation"], int(r["deviation_digits"])) == (n, far[k], far[k])
            assert r["explained"] == pytest.approx(explained[c], rel=1e-6) and r["identity_error"] < 1e-6


def made(many, wide, seed=1):
    rng = np.random.default_rng(seed)
    scale = 0.4 * 0.93 ** np.arange(wide)
    return [(i, [float(c) for c in np.float32(rng.normal(size=wide) * scale + 0.1)]) for i in range(many)]


def test_as_plain_rule(spark):
    vectors = made(300, 40)
    held_to(w.whiten(table(spark, vectors)).collect(), vectors)


def test_fewer_dimensions_than_components(spark):
    vectors = made(50, 5)
    rows = w.whiten(table(spark, vectors)).collect()
    assert {r["component"] for r in rows} == {1, 2, 3, 4, 5}
    held_to(rows, vectors)


def test_awkward_rows_take_no_part(spark):
    vectors = made(60, 4)
    odd = [(900, None), (901, []), (902, [1.0, None, 0.0, 0.0]), (903, [math.nan, 0.0, 0.0, 0.0]), (904, [math.inf, 0.0, 0.0, 0.0]), (905, [0.5] * 3), (906, [0.5] * 3)]
    rows = w.whiten(table(spark, vectors + odd)).collect()
    held_to(rows, vectors)


def test_repeated_rows_and_null_ids(spark):
    vectors = made(20, 3)
    twice = [*vectors, *vectors[:5], (None, vectors[7][1])]
    rows = w.whiten(table(spark, twice)).collect()
    assert len(rows) == 26 * 3 and sum(r["vec_id"] is None for r in rows) == 3
    assert {r["n"] for r in rows} == {26}


@pytest.mark.parametrize("vectors", [[], [(1, None)], [(1, [0.5, 0.25])], [(1, [0.5, 0.25]), (2, [0.5, 0.25])]])
def test_without_variance_no_rows(spark, vectors):
    out = w.whiten(table(spark, vectors))
    assert out.count() == 0 and out.columns[:2] == ["vec_id", "component"]


def test_components_without_variance_are_left_out(spark):
    flat = [(i, [float(i % 5), float(i % 3), 7.0]) for i in range(30)]
    assert {r["component"] for r in w.whiten(table(spark, flat)).collect()} == {1, 2}


def test_deviation_beyond_long():
    x = np.array([[2**45, 0], [0, 0]])
    away = w.distances(x, 2**30, np.array([2**45 * 2**29, 0], object))
    assert w.deviations(away).tolist() == [(2**75 - 2**74) ** 2, 2**148]


def test_large_entries_are_an_error(spark):
    with pytest.raises(Exception, match="beyond"):
        w.whiten(table(spark, [(1, [1e20, 0.0]), (2, [0.0, 1.0])]))
