"""Kernels against brute force, hand-worked grids and properties."""

from __future__ import annotations

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from hypothesis.extra import numpy as hnp

from rasterloom.operators import kernels as k
from rasterloom.operators.segments import line_segments, log_tail

MASKS = hnp.arrays(np.int64, st.tuples(st.integers(1, 9), st.integers(1, 9)), elements=st.integers(0, 1))
COSTS = hnp.arrays(np.float64, st.tuples(st.integers(2, 6), st.integers(2, 6)), elements=st.floats(1, 9))


@given(MASKS)
@settings(max_examples=60, deadline=None)
def test_distance_is_the_least_of_all(mask):
    got = k.distance(mask)
    on = np.argwhere(mask > 0)
    for r in range(mask.shape[0]):
        for c in range(mask.shape[1]):
            want = min((math.hypot(r - a, c - b) for a, b in on), default=math.hypot(*mask.shape))
            assert abs(got[r, c] - want) < 1e-9


@given(MASKS)
@settings(max_examples=60, deadline=None)
def test_thinning_stays_inside_and_settles(mask):
    once = k.thin(mask)
    assert not (once & (mask == 0)).any()
    assert (k.thin(once.astype(int)) == once).all()


@given(MASKS)
@settings(max_examples=40, deadline=None)
def test_hysteresis_keeps_what_touches(mask):
    v = mask * 50
    v.flat[0] = 200
    got = k.hysteresis(v, 40, 150)
    assert got.flat[0] and not (got & (v < 40)).any()


def dijkstra(cost, start):
    dist = {start: 0.0}
    todo = [start]
    while todo:
        at = todo.pop()
        for dr, dc, length in k.STEPS:
            to = (at[0] + dr, at[1] + dc)
            if 0 <= to[0] < cost.shape[0] and 0 <= to[1] < cost.shape[1] and dist[at] + cost[to] * length < dist.get(to, math.inf) - 1e-12:
                dist[to] = dist[at] + cost[to] * length
                todo.append(to)
    return dist


@given(COSTS)
@settings(max_examples=40, deadline=None)
def test_route_costs_what_the_cheapest_costs(cost):
    goal = (cost.shape[0] - 1, cost.shape[1] - 1)
    route, total, reached = k.least_cost(cost, (0, 0), goal)
    assert reached and abs(total - dijkstra(cost, (0, 0))[goal]) < 1e-9 and total >= math.hypot(*goal) - 1e-9
    assert all(max(abs(a - c), abs(b - d)) == 1 for (a, b), (c, d) in zip(route, route[1:]))


def test_route_to_its_start_and_cut_short():
    cost = np.ones((4, 9))
    assert k.least_cost(cost, (1, 1), (1, 1)) == ([(1, 1)], 0.0, True)
    route, _, reached = k.least_cost(cost, (0, 0), (0, 8), most=3)
    assert not reached and route[0] == (0, 0)


def test_ring_and_bar():
    ring = np.zeros((7, 7), int)
    ring[1:6, 1:6] = 1
    ring[2:5, 2:5] = 0
    assert k.thin(ring).sum() >= 8
    bar = np.zeros((4, 12), int)
    bar[1:3, 1:11] = 1
    assert 0 < k.thin(bar).sum() <= 12


def test_simplify_and_order():
    pts = np.array([[0, 0], [1, 0.1], [2, 0], [3, 5], [4, 0]], float)
    assert k.simplify(pts, 1.0).tolist() == [[0, 0], [2, 0], [3, 5], [4, 0]]
    mask = np.zeros((3, 5), bool)
    mask[1, [0, 1, 4]] = True
    assert k.in_order(mask) == [(1, 0), (1, 1), (1, 4)]


def planted(degrees, shape=(60, 70)):
    """A view with an edge through its middle, and how far from the edge a place is."""
    a = math.radians(degrees)
    far = lambda x, y: (x - shape[1] // 2) * math.sin(a) - (y - shape[0] // 2) * math.cos(a)
    r, c = np.indices(shape)
    return np.where(far(c, r) > 1e-9, 200, 40), far


@pytest.mark.parametrize("degrees", [0, 17, 30, 45, 60, 90, 133, 170])
def test_segments_of_a_planted_edge(degrees):
    view, far = planted(degrees)
    found = line_segments(view)
    assert len(found) and max(abs(far(x, y)) for s in found for x, y in (s[:2], s[2:4])) <= 1
    assert max(math.hypot(s[2] - s[0], s[3] - s[1]) for s in found) > 40


def test_segments_of_noise_and_of_nothing():
    assert sum(len(line_segments(np.random.default_rng(s).integers(0, 256, (40, 40)))) > 0 for s in range(100)) <= 5
    for shape in ((1, 1), (1, 9), (9, 1), (9, 9)):
        assert line_segments(np.full(shape, 7)).shape == (0, 8)


def test_a_bar_has_two_sides_that_run_opposite_ways():
    view = np.full((40, 60), 200)
    view[20:23, 5:55] = 40
    found = [s for s in line_segments(view) if abs(s[2] - s[0]) > 40]
    assert len(found) == 2 and found[0][2] > found[0][0] and found[1][2] < found[1][0] or found[0][2] < found[0][0] and found[1][2] > found[1][0]
    assert sorted(round((s[1] + s[3]) / 2, 1) for s in found) == [19.5, 22.5]


def test_tail_of_chance():
    factorials = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, 31)))])
    for n, m, p in ((30, 30, 0.125), (30, 7, 0.125), (12, 0, 0.0625), (25, 11, 0.03125)):
        plain = sum(math.comb(n, j) * p**j * (1 - p) ** (n - j) for j in range(m, n + 1))
        assert abs(log_tail(n, m, p, factorials) - math.log10(plain)) < 1e-9
