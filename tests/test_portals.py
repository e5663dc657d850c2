"""Costs over portals of tiles are those of a search of the whole image."""

from __future__ import annotations

import numpy as np
import pytest

from rasterloom.operators.kernels import least_cost
from rasterloom.operators.portals import least_costs, relaxed

REQUEST = "req_id long, img_id long, sr int, sc int, er int, ec int"


def maze(high, wide, seed):
    rng = np.random.default_rng(seed)
    cost = 1 + 9 * rng.random((high, wide))
    cost[4::9, : wide - 3] = 400.0  # walls with gaps at alternating ends
    cost[8::18, : wide - 3], cost[8::18, 3:] = 1.0, 400.0
    return cost


def test_as_a_whole_search(spark):
    images = {0: maze(53, 47, 1), 1: maze(20, 90, 2), 2: np.ones((3, 3))}
    rng = np.random.default_rng(3)
    asked = []
    for k in range(24):
        img = k % 3
        h, w = images[img].shape
        asked.append((k, img, *(int(v) for v in (rng.integers(h), rng.integers(w), rng.integers(h), rng.integers(w)))))
    asked += [(100, 0, 0, 0, 52, 46), (101, 0, 5, 5, 5, 5), (102, 0, 15, 15, 16, 16), (103, 1, 0, 0, 999, 0)]
    px = spark.createDataFrame([(i, r, c, float(v[r, c])) for i, v in images.items() for r in range(v.shape[0]) for c in range(v.shape[1])], "img_id long, r int, c int, cost double").repartition(5)
    got = {r["req_id"]: r["total"] for r in least_costs(px, spark.createDataFrame(asked, REQUEST), 16).collect()}
    want = {q: least_cost(images[i], (a, b), (c, d))[1] for q, i, a, b, c, d in asked if q != 103}
    assert set(got) == set(want) and all(got[q] == pytest.approx(want[q]) for q in want)


def test_relaxed_both_ways():
    cost = maze(12, 14, 5)
    forward = relaxed(cost, np.array([[2, 3]]))[0]
    assert forward[9, 10] == pytest.approx(least_cost(cost, (2, 3), (9, 10))[1]) == pytest.approx(relaxed(cost, np.array([[9, 10]]), True)[0][2, 3])


def test_nothing_asked(spark):
    px = spark.createDataFrame([(0, 0, 0, 1.0)], "img_id long, r int, c int, cost double")
    assert least_costs(px, spark.createDataFrame([], REQUEST), 16).count() == 0


@pytest.mark.parametrize("tall,most,rounds", [(96, 1024, False), (24, 20, True)])
def test_a_long_image_takes_few_rounds(spark, monkeypatch, tall, most, rounds):
    """Tiles are merged two by two, without a round of joins; with few portals allowed, rounds go on from there."""
    from rasterloom.operators import portals

    cost = maze(tall, 9, 4)
    px = spark.createDataFrame([(0, r, c, float(cost[r, c])) for r in range(tall) for c in range(9)], "img_id long, r int, c int, cost double")
    asked = [(0, 0, 0, 0, tall - 1, 8), (1, 0, tall - 3, 2, 5, 5)]
    names, write = [], portals.written_table
    monkeypatch.setattr(portals, "written_table", lambda df, name: names.append(name) or write(df, name))
    got = {r.req_id: r.total for r in portals.least_costs(px, spark.createDataFrame(asked, REQUEST), 8, most).collect()}
    assert all(got[q] == pytest.approx(least_cost(cost, (a, b), (c, d))[1]) for q, _, a, b, c, d in asked)
    assert ("portal-front" in names) == rounds and names.count("blocks") <= 7
