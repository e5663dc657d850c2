"""The detectors' view kernels against the same steps as relations and against plain loops."""

from __future__ import annotations

import math

import numpy as np
import pytest

from rasterloom.operators import kernels, raster
from rasterloom.plans import rasters
from rasterloom.plans.fixtures import gray

SF = "/root/testdata/sf0.001"


def views(seed=1, n=3, shape=(23, 31)):
    rng = np.random.default_rng(seed)
    return [rng.integers(0, 256, shape).astype("i4") for _ in range(n)]


def on(df):
    return {(r.img_id, r.r, r.c) for r in df.select("img_id", "r", "c").collect()}


def test_canny_is_as_the_relations_say(spark):
    px = gray(spark, SF)
    assert on(rasters.canny(px)) == on(rasters.canny_relational(px))


def test_lines_are_as_the_relations_say(spark):
    px = gray(spark, SF)
    assert on(rasters.detect_lsd(spark, SF)) == on(rasters.lsd_relational(px))


@pytest.mark.parametrize("name", ["detect_canny", "detect_lsd", "edge_cache", "edge_rows", "morph_close", "sam_mask"])
def test_few_scans_of_a_view(spark, name):
    plan = getattr(rasters, name)(spark, SF)._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
    assert plan.count("FileScan") <= 3 and plan.count("Exchange") <= 6


def test_local_steps_are_as_the_relations_say(spark):
    px = gray(spark, SF)
    rows = lambda df, *c: {tuple(r) for r in df.select("img_id", "r", "c", *c).collect()}
    assert rows(rasters.gaussian_blur_3x3(spark, SF), "g") == rows(raster.blur(px), "g")
    assert rows(rasters.adaptive_threshold_inv(spark, SF), "on") == rows(raster.adaptive_threshold_inv(px, 10), "on")
    assert rows(rasters.sobel_gradient(spark, SF), "gx", "gy", "mag") == rows(raster.sobel(px), "gx", "gy", "mag")
    assert rows(rasters.canny_nms(spark, SF), "mag") == rows(raster.thin_gradient(raster.sobel(px)), "mag")
    assert on(rasters.morph_close(spark, SF)) == on(raster.close(px.where("g > 150"), raster.extents(px), 3))


def test_prompted_masks(spark):
    """Of a made view: the connected region of the prompt's level, closed; none where it is too small or too large."""
    v = np.zeros((20, 20), "i4")
    v[5:10, 5:12] = 200
    v[15:18, 15:18] = 200
    want = np.zeros(v.shape, bool)
    want[5:10, 5:12] = True
    assert (kernels.prompted_mask(v, 7, 7, 40, 24, 0.35) == want).all()
    assert not kernels.prompted_mask(v, 16, 16, 40, 24, 0.35).any() and not kernels.prompted_mask(v, 0, 0, 40, 24, 0.35).any()
    got = rasters.sam_mask(spark, SF).groupBy("img_id").count().collect()
    assert all(24 <= r["count"] <= 0.35 * 3200 for r in got)


def test_best_route_of_each_request(spark):
    """optimal_path takes the mask's route, else the edge costs', else the goal alone. The mask's route ends at the pixel of
    the centre line (where start or goal has none within 20, of the mask) that is in the nearest ring to the goal and closest
    there, the edge costs' at the goal."""
    from rasterloom.plans import routes

    line, body = {}, {}
    for kernel, told in ((kernels.mask_line, line), (lambda g, outside: kernels.close(g >= outside, 3), body)):
        levels = {}
        for r in gray(spark, SF).collect():
            levels.setdefault(r.img_id, np.zeros((50, 64), int))[r.r, r.c] = r.g
        for i, v in levels.items():
            told[i] = [tuple(p) for p in np.argwhere(kernel(v, rasters.MASK_LEVEL)).tolist()]

    def nearest(pixels, r, c):
        found = [(max(abs(a - r), abs(b - c)), (a - r) ** 2 + (b - c) ** 2, a, b) for a, b in pixels]
        return min((f for f in found if f[0] <= 20), default=(None,) * 4)[2:]

    asked = {r.req_id: r for r in routes.requests(spark, SF).collect()}
    ends = {r.req_id: (r.er, r.ec) for r in routes.requests(spark, SF).collect()}
    ways = {n: {} for n in ("sam", "edge")}
    for name, df in (("sam", routes.sam_path(spark, SF)), ("edge", routes.astar_path(spark, SF))):
        for r in sorted(df.collect(), key=lambda r: r.seq):
            ways[name].setdefault(r.req_id, []).append((r.r, r.c))
    got = {r.req_id: [tuple(p) for p in r.path] for r in routes.optimal_path(spark, SF).collect()}
    assert got == {i: ways["sam"].get(i) or ways["edge"].get(i) or [e] for i, e in ends.items()}
    for i, path in got.items():
        q = asked[i]
        if i in ways["sam"]:
            pixels = line[q.img_id]
            if None in nearest(pixels, q.sr, q.sc) + nearest(pixels, q.er, q.ec):
                pixels = body[q.img_id]
            assert path[-1] == nearest(pixels, q.er, q.ec)
        else:
            assert path[-1] == ends[i]
    assert ways["sam"] and len(got) == len(ends)


def around(v, r, c, reach):
    return [(i, j) for i in range(r - reach, r + reach + 1) for j in range(c - reach, c + reach + 1) if 0 <= i < v.shape[0] and 0 <= j < v.shape[1]]


@pytest.mark.parametrize("seed", range(3))
def test_spread_against_flood(seed):
    rng = np.random.default_rng(seed)
    allowed = rng.random((40, 50)) < 0.4
    seed_at = rng.random((40, 50)) < 0.02
    want, todo = np.zeros(allowed.shape, bool), [tuple(p) for p in np.argwhere(seed_at & allowed)]
    while todo:
        r, c = todo.pop()
        if not want[r, c]:
            want[r, c] = True
            todo += [p for p in around(allowed, r, c, 1) if allowed[p]]
    assert (kernels.spread(seed_at, allowed) == want).all()


@pytest.mark.parametrize("size", [2, 3])
def test_close_against_loops(size):
    v = views()[0] > 200
    a, b = size // 2, size - 1 - size // 2
    box = lambda r, c: [(r + i, c + j) for i in range(-a, b + 1) for j in range(-a, b + 1) if 0 <= r + i < v.shape[0] and 0 <= c + j < v.shape[1]]
    fat = np.array([[any(v[p] for p in box(r, c)) for c in range(v.shape[1])] for r in range(v.shape[0])])
    lean = np.array([[all(fat[p] for p in box(r, c)) for c in range(v.shape[1])] for r in range(v.shape[0])])
    assert (kernels.close(v, size) == lean).all()


@pytest.mark.parametrize("share", [0.01, 0.3, 1.0])
def test_order_of_pixels_against_all_pairs(share):
    mask = np.random.default_rng(4).random((60, 70)) < share
    left = [tuple(p) for p in np.argwhere(mask).tolist()]
    want, here = [left.pop(0)], None
    while left:
        here = want[-1]
        left.sort()
        want.append(left.pop(min(range(len(left)), key=lambda k: ((left[k][0] - here[0]) ** 2 + (left[k][1] - here[1]) ** 2, left[k]))))
    assert kernels.in_order(mask) == want


def test_distance_far_from_all():
    v = np.zeros((30, 40), "i4")
    v[3, 5] = v[29, 39] = 1
    want = [[min(math.hypot(r - 3, c - 5), math.hypot(r - 29, c - 39)) for c in range(40)] for r in range(30)]
    assert np.allclose(kernels.distance(v), want)


def test_mask_cost_of_a_bar():
    g = np.zeros((9, 12), "i4")
    g[2:7, 2:10] = 100
    g[2, 2:10] = 200
    cost = kernels.mask_cost(g, 60, 128, rasters.MASK_COSTS)
    assert cost[0, 0] == 12 and cost.min() == 1
    assert cost[2, 4] == pytest.approx(1.6 - 0.75 / 3) and cost[6, 4] == pytest.approx(2.5 - 0.75 / 3)  # one from outside, three at most
    centre = kernels.thin((g > 0).astype("u1"))
    assert (cost[centre] == 1).all() and (cost[~centre & (g > 0)] > 1).all()


def test_large_views_are_refused():
    with pytest.raises(ValueError):
        kernels.dense(np.array([0]), np.array([kernels.LIMIT]), np.array([1]))


def test_routes_break_ties_by_column():
    """On a flat grid all shortest ways cost the same; of equal promises the lower column, then the lower row, goes first."""
    route, total, reached = kernels.least_cost(np.ones((3, 4)), (0, 0), (2, 3))
    assert reached and total == pytest.approx(1 + 2 * math.sqrt(2)) and route[0] == (0, 0) and route[-1] == (2, 3)
    assert kernels.least_cost(np.ones((3, 4)), (0, 0), (2, 3), 1)[0] == [(0, 0)]


def test_edge_cache_is_one_at_edges(spark):
    found, edges = rasters.edge_cache(spark, SF).collect(), on(rasters.detect_edges(spark, SF))
    assert {(r.img_id, r.r, r.c) for r in found if r.cost == 1.0} == edges and len(found) == gray(spark, SF).count()
    shown = rasters.preview_edges(spark, SF)
    assert on(shown) == edges and shown.where("on <> 255").isEmpty()
