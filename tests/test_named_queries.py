"""The queries that have no DuckDB twin, each held to rows made another way."""

from __future__ import annotations

import hashlib
import json

import numpy as np
import pytest

import __spark_entry__ as entry
from rasterloom.operators import kernels
from rasterloom.operators.segments import line_segments
from rasterloom.plans import rasters, routes
from rasterloom.plans.fixtures import gray, line_pts, lines, weights

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def views(spark):
    """img_id -> levels."""
    out = {}
    for r in gray(spark, SF).collect():
        out.setdefault(r["img_id"], np.zeros((50, 64), int))[r["r"], r["c"]] = r["g"]
    return out


def query(spark, name):
    return entry.queries()[name](spark, SF).collect()


def on(views, kernel):
    return {(i, int(r), int(c)) for i, v in views.items() for r, c in zip(*np.nonzero(kernel(v)))}


def test_sam_cost_map(spark, views):
    """From the definition: distances by all pairs, the mask closed by hand."""
    got = {(r["img_id"], r["r"], r["c"]): r["cost"] for r in query(spark, "sam_cost_map")}
    for i, g in list(views.items())[:2]:
        pad = np.pad(g >= 60, 1)
        fat = np.logical_or.reduce([pad[a : a + 50, b : b + 64] for a in range(3) for b in range(3)])
        pad = np.pad(fat, 1, constant_values=True)
        closed = np.logical_and.reduce([pad[a : a + 50, b : b + 64] for a in range(3) for b in range(3)])
        off = np.argwhere(~closed)
        far = np.full(g.shape, np.hypot(*g.shape))
        for r, c in np.argwhere(closed) if len(off) else ():
            far[r, c] = np.sqrt(((off - (r, c)) ** 2).sum(1).min())
        line = kernels.thin(closed.astype(int))
        for r in range(50):
            for c in range(64):
                cost = 12.0 if not closed[r, c] else (1.6 if g[r, c] > 128 else 2.5) - far[r, c] / far.max() * 0.75
                assert got[i, r, c] == pytest.approx(1.0 if line[r, c] else max(cost, 1.0))


def test_masks(spark, views):
    found = lambda name: {tuple(r)[:3] for r in query(spark, name)}
    assert found("thin_mask") == on(views, lambda v: kernels.thin((v > 150).astype(int)))
    assert found("detect_edges") == on(views, lambda v: kernels.thin(kernels.canny(v, 30, 100, 10)))
    preview = query(spark, "preview_edges")
    assert {tuple(r)[:3] for r in preview} == found("detect_edges") and {(r["on"], r["x_min"], r["y_max"]) for r in preview} == {(255, 0.0, 50.0)}


def test_thinning_leaves_lines(views):
    for v in list(views.values())[:3]:
        mask = v > 150
        line = kernels.thin(mask.astype(int))
        assert not (line & ~mask).any()
        # No part falls in two (a block of 2 x 2 goes as a whole, as this method has it), and a further round takes nothing.
        parts = kernels.labels_of(mask)
        left = kernels.labels_of(line)
        assert len({(parts[r, c], left[r, c]) for r, c in np.argwhere(line)}) == len(np.unique(parts[line]))
        assert all((parts == k).sum() == 4 for k in set(np.unique(parts)) - set(np.unique(parts[line])) - {0})
        assert (kernels.thin_round(line) == line).all()


def cheapest(cost, start):
    """Costs to all pixels by repeated relaxation of the whole view."""
    d = np.full(cost.shape, np.inf)
    d[start] = 0
    while True:
        wide, best = np.pad(d, 1, constant_values=np.inf), d.copy()
        for dr, dc, length in kernels.STEPS:
            best = np.minimum(best, wide[1 + dr : 1 + dr + d.shape[0], 1 + dc : 1 + dc + d.shape[1]] + length * cost)
        if np.allclose(best, d, atol=0, rtol=0, equal_nan=True):
            return d
        d = best


def test_routes(spark, views):
    asked = {r["req_id"]: r for r in routes.requests(spark, SF).collect()}
    whole, alone = {}, {}
    for name, into in (("astar_standalone", whole), ("astar_path", alone)):
        for r in sorted(query(spark, name), key=lambda r: r["seq"]):
            into.setdefault(r["req_id"], []).append(r)
    assert set(whole) == set(asked)
    for q, steps in whole.items():
        cost, a = 1 + views[asked[q]["img_id"]] / 16.0, asked[q]
        at = [(r["r"], r["c"]) for r in steps]
        assert at[0] == (a["sr"], a["sc"]) and at[-1] == (a["er"], a["ec"]) and [(r["r"], r["c"]) for r in alone.get(q, [])] == at[1:]
        assert all(max(abs(p[0] - n[0]), abs(p[1] - n[1])) == 1 for p, n in zip(at, at[1:]))
        assert sum(np.hypot(p[0] - n[0], p[1] - n[1]) * cost[n] for p, n in zip(at, at[1:])) == pytest.approx(cheapest(cost, at[0])[at[-1]]) == pytest.approx(steps[0]["total"])
    for r in query(spark, "priority_frontier"):
        assert not r["reached"] and max(abs(r["r"]), abs(r["c"])) <= 12


def test_way_by_outcome(spark):
    kinds = "req_id long, img_id long, sr int, sc int, er int, ec int"
    asked = spark.createDataFrame([(1, 0, 0, 0, 5, 9), (2, 0, 0, 0, 5, 9), (3, 0, 0, 0, 5, 9)], kinds)
    step = "req_id long, seq int, r int, c int"
    first, second = spark.createDataFrame([(1, 2, 5, 9), (1, 1, 2, 3)], step), spark.createDataFrame([(1, 1, 8, 8), (2, 1, 4, 4)], step)
    assert {r["req_id"]: (r["by"], [tuple(p) for p in r["path"]]) for r in routes.way(asked, first, second).collect()} == {1: ("mask", [(2, 3), (5, 9)]), 2: ("edge", [(4, 4)]), 3: ("goal", [(5, 9)])}


def test_mask_route(spark):
    """A bar of the mask with its centre line: ends snap to the line, not to an edge that costs as little, and no end within 20 means no route."""
    cost = np.full((40, 60), 12.0)
    cost[18:23, 5:38] = 2.5
    cost[20, 5:38] = cost[18, 5:38] = 1.0
    line = spark.createDataFrame([(0, 20, c) for c in range(5, 38)], "img_id long, r int, c int")
    px = spark.createDataFrame([(0, r, c, float(cost[r, c])) for r in range(40) for c in range(60)], "img_id long, r int, c int, cost double")
    asked = spark.createDataFrame([(1, 0, 10, 5, 25, 37), (2, 0, 10, 5, 20, 57), (3, 0, 10, 5, 20, 58)], "req_id long, img_id long, sr int, sc int, er int, ec int")
    got = {}
    for r in sorted(routes.mask_route(asked, px, line, 12.0).collect(), key=lambda r: r["seq"]):
        got.setdefault(r["req_id"], []).append((r["r"], r["c"]))
    assert got == {1: [(20, c) for c in range(6, 38)], 2: [(20, c) for c in range(6, 38)]}


def test_optimal_path(spark):
    by = {r["by"] for r in query(spark, "optimal_path")}
    mask = {r["req_id"] for r in query(spark, "sam_path")}
    assert by <= {"mask", "edge", "goal"} and {r["req_id"] for r in query(spark, "optimal_path") if r["by"] == "mask"} == mask


def test_pixel_orders_and_lines(spark, views):
    order = {}
    for r in sorted(query(spark, "nn_order"), key=lambda r: r["seq"]):
        order.setdefault(r["img_id"], []).append((r["r"], r["c"]))
    for i, v in views.items():
        left = [tuple(map(int, p)) for p in np.argwhere(v > 150)]
        want = [left.pop(0)] if left else []
        while left:
            want.append(left.pop(min(range(len(left)), key=lambda k: ((left[k][0] - want[-1][0]) ** 2 + (left[k][1] - want[-1][1]) ** 2, left[k]))))
        assert order.get(i, []) == want
    pts = {}
    for r in line_pts(spark, SF).collect():
        pts.setdefault(r["line_id"], []).append((r["seq"], r["x"], r["y"]))

    def kept(p, tolerance):
        (ax, ay), (bx, by) = p[0], p[-1]
        size = np.hypot(bx - ax, by - ay)
        off = [abs((bx - ax) * (y - ay) - (by - ay) * (x - ax)) / size if size else np.hypot(x - ax, y - ay) for x, y in p[1:-1]]
        if not off or max(off) <= tolerance:
            return [p[0], p[-1]] if len(p) > 1 else p
        k = int(np.argmax(off)) + 1
        return kept(p[: k + 1], tolerance)[:-1] + kept(p[k:], tolerance)

    got = {}
    for r in sorted(query(spark, "simplify_line"), key=lambda r: r["seq"]):
        got.setdefault(r["line_id"], []).append((r["x"], r["y"]))
    assert got == {i: kept([q[1:] for q in sorted(p)], 5.0) for i, p in pts.items()}
    made = {}
    for r in sorted(query(spark, "mask_to_line"), key=lambda r: r["seq"]):
        made.setdefault(r["line_id"], []).append((r["x"], r["y"]))
    for i, v in views.items():
        thin = kernels.in_order(kernels.thin((v > 150).astype(int)))
        want = kept([(float(c), float(r)) for r, c in thin], 1.0) if len(thin) > 1 else None
        assert made.get(i) == want


def test_segments_of_all_views(spark, views):
    """The query's rows are those of each view alone; a planted edge among the views is found."""
    names = kernels.SEGMENT
    rows = lambda found: sorted((r["img_id"], *(round(r[n], 6) for n in names)) for r in found)
    alone = sorted((i, *(round(float(x), 6) for x in s)) for i, v in views.items() for s in line_segments(v))
    assert rows(query(spark, "lsd_segments")) == alone
    edge = spark.createDataFrame([(7, r, c, 200 if c > 20 else 40) for r in range(30) for c in range(40)] + [(8, r, c, 9) for r in range(5) for c in range(5)], "img_id long, r int, c int, g int")
    found = kernels.segments_of(edge).collect()
    assert [(r["img_id"], r["x1"], r["x2"]) for r in found] == [(7, 20.5, 20.5)] and found[0]["nfa"] > 0


def test_layers_and_files(spark, views):
    want = {r["fid"]: r for r in lines(spark, SF).collect()}
    assert {r["fid"]: r for r in query(spark, "sink_memory_lines")} == want
    # Each view's file, byte by byte.
    files = [json.dumps([{"r": r, "c": c, "g": int(v[r, c])} for r in range(50) for c in range(64)], separators=(",", ":")) + "\n" for v in views.values()]
    assert sorted(r["sha256"] for r in query(spark, "release_manifest")) == sorted(hashlib.sha256(f.encode()).hexdigest() for f in files)
    assert sorted(r["length"] for r in query(spark, "file_signature")) == sorted(map(len, files))
    told = {r["key"]: tuple(r[c] for c in ("ok", "etag", "last_modified", "content_length")) for r in weights(spark, SF)[1].collect()}
    report = query(spark, "sink_json_report")
    assert {r["key"]: tuple(r[c] for c in ("ok", "etag", "last_modified", "content_length")) for r in report} == told and len({r["made"] for r in report}) == 1


def test_stand_ins_are_deterministic(spark, views):
    """They stand where a network would; what can be held to is that they say the same of the same view."""
    assert sorted(query(spark, "hed_forward")) == sorted(query(spark, "hed_forward"))
    grown = {tuple(r)[:3] for r in query(spark, "sam_predict")}
    assert grown == on(views, lambda v: kernels.grow_mask(v, 25, 32, 18)) and {(i, 25, 32) for i in views} <= grown
    hed = {tuple(r)[:3] for r in query(spark, "detect_hed")}
    even, odd = {i: v for i, v in views.items() if i % 2 == 0}, {i: v for i, v in views.items() if i % 2}
    assert hed == on(even, lambda v: kernels.network_edges(v, rasters.PRESENT)) | on(odd, lambda v: kernels.canny(v, 30, 100, 10))
    means = {r["img_id"]: r["embedding"] for r in query(spark, "sam_set_image")}
    assert all(np.allclose(means[i], v[:50, :64].reshape(5, 10, 8, 8).mean((1, 3)).ravel()) for i, v in views.items())


def test_ways_to_the_root_have_no_limit_of_rows(spark, tmp_path):
    """More than the million rows that Spark allows a recursion; awkward and largest leaves too."""
    from rasterloom.plans.routes import path_reconstruct

    odd = [0, 1, -7, 3**39 - 1, 3**39, 2**63 - 1]
    leaves = spark.range(1, 120_001).selectExpr("id as c_custkey").unionByName(spark.createDataFrame([(k,) for k in odd] + [(None,)], "c_custkey long"))
    leaves.write.parquet(f"{tmp_path}/customer.parquet")
    found = path_reconstruct(spark, str(tmp_path))
    assert found.count() > 1_000_000 and dict(found.dtypes) == {"leaf": "bigint", "depth": "int", "node": "bigint"}
    got = {}
    for r in found.where("leaf is null or leaf > 120000 or leaf < 1000").collect():
        got.setdefault(r.leaf, []).append((r.depth, r.node))
    for leaf in [*odd, None, 999]:
        way = [leaf]
        while way[-1] is not None and way[-1] > 0:
            way.append(way[-1] // 3)
        assert sorted(got[leaf], key=lambda t: t[0]) == sorted([*enumerate(way)] * (2 if leaf == 1 else 1), key=lambda t: t[0])
