"""Operators that are global or sequential within one image: each image is one group, handled with NumPy.

A view has at most LIMIT pixels an axis, which is checked, so a group is bounded; work is parallel over images.
Every kernel takes a dense array and gives a mask (rows img_id, r, c) or values (rows with value). The detectors run all
their steps on a view in one kernel, so its pixels are shuffled once; operators.raster has the same steps as relations.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .lines import per_line
from .raster import ADAPTIVE, ADAPTIVE_SIZE
from .segments import NAMES as SEGMENT
from .segments import line_segments

#: Neighbours of a pixel and the lengths of the steps to them.
STEPS = tuple((dr, dc, math.sqrt(dr * dr + dc * dc)) for dr in (-1, 0, 1) for dc in (-1, 0, 1) if dr or dc)


#: Most pixels of a view along an axis.
LIMIT = 1000


def dense(r: np.ndarray, c: np.ndarray, v: np.ndarray) -> np.ndarray:
    if len(r) and max(int(r.max()), int(c.max())) >= LIMIT:
        raise ValueError(f"a view has at most {LIMIT} pixels an axis; resample it first")
    out = np.zeros((int(r.max()) + 1, int(c.max()) + 1), v.dtype)
    out[r, c] = v
    return out


def per_image(px: DataFrame, value: str, kernel: Callable[..., np.ndarray | tuple], columns: str = "value double", **options) -> DataFrame:
    """kernel over each image of px (img_id, r, c, value): one of MASKS gives its on-pixels, another all pixels, with an
    array for each of the columns (names and types, as in a schema)."""
    names = [] if kernel in MASKS else [c.split()[0] for c in columns.split(",")]
    kinds = {"int": "i4", "double": "f8"}
    types = [] if kernel in MASKS else [kinds[c.split()[1]] for c in columns.split(",")]

    def go(group: pa.Table) -> pa.Table:
        r, c, v = (group.column(n).to_numpy() for n in ("r", "c", value))
        out = kernel(dense(r, c, v), **options)
        if not names:
            (rows, cols), extra = np.nonzero(out), {}
        else:
            outs = out if isinstance(out, tuple) else (out,)
            rows, cols = (x.ravel() for x in np.indices(outs[0].shape))
            extra = {n: pa.array(o.ravel().astype(t)) for n, t, o in zip(names, types, outs)}
        return pa.table({"img_id": pa.array(np.full(len(rows), group.column("img_id")[0].as_py())), "r": pa.array(rows.astype("i4")), "c": pa.array(cols.astype("i4")), **extra})

    schema = "img_id bigint, r int, c int" + ("" if kernel in MASKS else f", {columns}")
    return px.select("img_id", "r", "c", value).groupby("img_id").applyInArrow(go, schema)


def shifted(a: np.ndarray, dr: int, dc: int) -> np.ndarray:
    """a's neighbour at (dr, dc), zeros outside."""
    h, w = a.shape
    out = np.zeros_like(a)
    out[max(0, -dr) : h - max(0, dr), max(0, -dc) : w - max(0, dc)] = a[max(0, dr) : h - max(0, -dr), max(0, dc) : w - max(0, -dc)]
    return out


def labels_of(allowed: np.ndarray) -> np.ndarray:
    """The number, from 1, of each allowed pixel's component over eight neighbours, 0 elsewhere: runs of each row are
    joined with those that touch them in the row above."""
    h, w = allowed.shape
    padded = np.zeros((h, w + 2), "i1")
    padded[:, 1:-1] = allowed
    change = np.diff(padded, axis=1)
    rows, first = np.nonzero(change == 1)
    last = np.nonzero(change == -1)[1] - 1
    parent = list(range(len(rows)))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    # Runs are ordered by row and column, so the runs of the row above that touch one are neighbours in the order.
    above_first = np.searchsorted(rows * (w + 2) + last, (rows - 1) * (w + 2) + first - 1)
    above_end = np.searchsorted(rows * (w + 2) + first, (rows - 1) * (w + 2) + last + 1, "right")
    for i, (a, b) in enumerate(zip(above_first.tolist(), above_end.tolist())):
        for k in range(a, b):
            parent[find(i)] = find(k)
    number = np.zeros(allowed.shape, "i8")
    number[allowed] = np.repeat(np.array([find(i) for i in range(len(rows))], "i8"), last - first + 1) + 1
    return number


def spread(seed: np.ndarray, allowed: np.ndarray) -> np.ndarray:
    """The allowed pixels that touch seed, over eight neighbours and any number of steps."""
    number = labels_of(allowed)
    reached = np.zeros(int(number.max(initial=0)) + 1, bool)
    reached[number[seed & allowed]] = True
    reached[0] = False
    return reached[number]


def hysteresis(v: np.ndarray, low: float, high: float) -> np.ndarray:
    return spread(v >= high, v >= low)


def grow_mask(v: np.ndarray, row: int, col: int, within: int) -> np.ndarray:
    """The stand-in for a prompted mask: connected pixels whose level is near the prompt's."""
    row, col = min(row, v.shape[0] - 1), min(col, v.shape[1] - 1)
    seed = np.zeros(v.shape, bool)
    seed[row, col] = True
    return spread(seed, np.abs(v.astype(int) - int(v[row, col])) <= within)


def thin_round(on: np.ndarray) -> np.ndarray:
    """Two passes of Zhang and Suen (1984) that take border pixels off both sides; each looks one pixel far."""
    ring = ((-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1))
    for first in (True, False):
        p = [shifted(on, *d) for d in ring]
        count = sum(x.astype("i1") for x in p)
        rises = sum((~a & b).astype("i1") for a, b in zip(p, p[1:] + p[:1]))
        n, e, s, w = p[0], p[2], p[4], p[6]
        sides = (~(n & e & s) & ~(e & s & w)) if first else (~(n & e & w) & ~(n & s & w))
        on = on & ~((count >= 2) & (count <= 6) & (rises == 1) & sides)
    return on


def thin(v: np.ndarray) -> np.ndarray:
    """Rounds of thinning until no pixel goes."""
    on, after = v > 0, None
    while True:
        after = thin_round(on)
        if (after == on).all():
            return on
        on = after


def distance(on: np.ndarray) -> np.ndarray:
    """Exact Euclidean distance to the nearest on-pixel; the image's diagonal where there is none."""
    h, w = on.shape
    if not (on > 0).any():
        return np.full(on.shape, math.hypot(h, w))
    far = float(h + w)
    up = np.where(on > 0, 0.0, far)
    for r in range(1, h):  # along columns, down and up
        up[r] = np.minimum(up[r], up[r - 1] + 1)
    for r in range(h - 2, -1, -1):
        up[r] = np.minimum(up[r], up[r + 1] + 1)
    square, best = np.where(up >= far, np.inf, up * up), np.full(on.shape, np.inf)
    for d in range(w):  # along rows, from every column at distance d, until none that far can be nearer
        if d * d >= best.max():
            break
        best[:, d:] = np.minimum(best[:, d:], square[:, : w - d] + d * d)
        best[:, : w - d] = np.minimum(best[:, : w - d], square[:, d:] + d * d)
    return np.sqrt(best)


def stand_in_edges(v: np.ndarray) -> np.ndarray:
    """Stands for a network's probability map where no weights are at hand: the local contrast, 0 to 1."""
    around = np.stack([shifted(v.astype("f8"), dr, dc) for dr, dc, _ in STEPS])
    return np.clip(np.abs(around - v).max(0) / 255.0, 0, 1)


def blur(g: np.ndarray) -> np.ndarray:
    """operators.raster.blur of one view."""
    s, w = np.zeros(g.shape, "i8"), np.zeros(g.shape, "i8")
    for dr in (-1, 0, 1):
        for dc in (-1, 0, 1):
            k = (2 - abs(dr)) * (2 - abs(dc))
            s += k * shifted(g.astype("i8"), dr, dc)
            w += k * shifted(np.ones(g.shape, "i8"), dr, dc)
    return (2 * s + w) // (2 * w)


def sobel(g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """gx and gy of operators.raster.sobel."""
    g = g.astype("i8")
    gx = sum(dc * (2 - abs(dr)) * shifted(g, dr, dc) for dr, dc, _ in STEPS)
    gy = sum(dr * (2 - abs(dc)) * shifted(g, dr, dc) for dr, dc, _ in STEPS)
    whole = np.zeros(g.shape, bool)
    whole[1:-1, 1:-1] = True
    return gx * whole, gy * whole


def thin_gradient(gx: np.ndarray, gy: np.ndarray) -> np.ndarray:
    """mag of operators.raster.thin_gradient."""
    mag, ax, ay = np.abs(gx) + np.abs(gy), np.abs(gx), np.abs(gy)
    flat, steep = ay * 1000 <= ax * 414, ay * 414 >= ax * 1000
    peak = np.zeros(mag.shape, bool)
    for where, dr, dc in ((flat, 0, 1), (~flat & steep, 1, 0), (~flat & ~steep & (gx * gy > 0), 1, 1), (~flat & ~steep & (gx * gy <= 0), 1, -1)):
        peak |= where & (mag > shifted(mag, -dr, -dc)) & (mag >= shifted(mag, dr, dc))
    return np.where(peak, mag, 0)


def below_mean(g: np.ndarray, offset: int) -> np.ndarray:
    """Where operators.raster.adaptive_threshold_inv is on."""
    s, w = g.astype("i8"), np.ones(g.shape, "i8")
    half = ADAPTIVE_SIZE // 2
    for axis in (0, 1):
        at = lambda a, d: shifted(a, *((d, 0) if axis == 0 else (0, d)))  # noqa: E731, B023
        s, w = (sum(k * at(a, i - half) for i, k in enumerate(ADAPTIVE)) for a in (s, w))
    return g * w <= s - offset * w


def close(on: np.ndarray, size: int) -> np.ndarray:
    """operators.raster.close: dilated, then eroded; what lies outside the view is ignored."""
    a = size // 2
    steps = [(i - a, j - a) for i in range(size) for j in range(size)]
    fat = np.logical_or.reduce([shifted(on, dr, dc) for dr, dc in steps])
    return ~np.logical_or.reduce([shifted(~fat, dr, dc) for dr, dc in steps])


def canny(g: np.ndarray, low: int, high: int, offset: int) -> np.ndarray:
    """Blur, gradient, thinned ridges and hysteresis, joined with the adaptive mask and closed with a 2 x 2 element."""
    return close(hysteresis(ridges(blur(g)), low, high) | below_mean(g, offset), 2)


def edges(g: np.ndarray, low: int, high: int, offset: int) -> np.ndarray:
    """Canny's edges as centre lines."""
    return thin(canny(g, low, high, offset))


def gradient(g: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """gx, gy and their magnitude."""
    gx, gy = sobel(g)
    return gx, gy, np.abs(gx) + np.abs(gy)


def ridges(g: np.ndarray) -> np.ndarray:
    """The gradient's magnitude where no neighbour along its direction is larger."""
    return thin_gradient(*sobel(g))


def adaptive(g: np.ndarray, offset: int) -> np.ndarray:
    return np.where(below_mean(g, offset), 255, 0)


def closed_above(g: np.ndarray, level: int, size: int) -> np.ndarray:
    """Pixels above the level, closed."""
    return close(g > level, size)


def dark_lines(g: np.ndarray, level: int, size: int) -> np.ndarray:
    """Pixels that are below the level when blurred, closed."""
    return close(blur(g) < level, size)


def drawn(segments: np.ndarray, shape: tuple[int, int], width: int = 2) -> np.ndarray:
    """operators.raster.rasterize of whole-number ends inside a view."""
    on = np.zeros(shape, bool)
    for x1, y1, x2, y2 in ((int(v) for v in s[:4]) for s in segments):
        n = max(abs(x2 - x1), abs(y2 - y1))
        i = np.arange(n + 1)
        r, c = (np.floor(a + i * (b - a) / max(n, 1) + 0.5).astype(int) for a, b in ((y1, y2), (x1, x2)))
        for dr in range(width):
            for dc in range(width):
                good = (r + dr >= 0) & (r + dr < shape[0]) & (c + dc >= 0) & (c + dc < shape[1])
                on[r[good] + dr, c[good] + dc] = True
    return on


def line_edges(g: np.ndarray, offset: int) -> np.ndarray:
    """Line segments drawn two pixels wide, joined with the adaptive mask and closed with a 3 x 3 element."""
    return close(drawn(line_segments(g), g.shape) | below_mean(g, offset), 3)


def network_edges(g: np.ndarray, level: int) -> np.ndarray:
    """The stand-in network's map as levels, above `level`, closed with a 2 x 2 element."""
    return close(np.floor(stand_in_edges(g) * 255) > level, 2)


def prompted_mask(g: np.ndarray, row: int, col: int, within: int, least: int, share: float) -> np.ndarray:
    """The stand-in's mask closed with a 3 x 3 element; none if it is a speck or a large part of the view."""
    on = close(grow_mask(g, row, col, within), 3)
    return on & (least <= on.sum() <= int(share * on.size))


def edge_distance(g: np.ndarray, low: int, high: int, offset: int) -> np.ndarray:
    return distance(edges(g, low, high, offset))


def mask_cost(g: np.ndarray, outside: int, edge: int, costs: tuple[float, float, float, float, float]) -> np.ndarray:
    """The cost of each pixel by a mask, here the levels from `outside` on: costs are those outside, inside, on edges
    (levels above `edge`) inside, what the middle is cheaper by, and of the centre line, below which none is."""
    out, inside, on_edge, bonus, least = costs
    closed = close(g >= outside, 3)
    cost = np.where(closed, np.where(g > edge, on_edge, inside), out)
    far = np.where(closed, distance(~closed), 0.0)
    if closed.any() and far.max() > 0:
        cost = cost - np.where(closed, far / far.max() * bonus, 0.0)
    return np.maximum(np.where(thin(closed.astype("u1")), least, cost), least)


def mask_line(g: np.ndarray, outside: int) -> np.ndarray:
    """The centre line of a mask, closed as in mask_cost. Its pixels are not told by their cost, as edges in the middle cost the least too."""
    return thin(close(g >= outside, 3).astype("u1"))


MASKS = (hysteresis, grow_mask, thin, canny, edges, closed_above, dark_lines, line_edges, network_edges, prompted_mask, mask_line)


def segments_of(px: DataFrame, value: str = "g") -> DataFrame:
    """img_id and the segments of each image of px (img_id, r, c, value)."""

    def go(group: pa.Table) -> pa.Table:
        rows = line_segments(dense(*(group.column(n).to_numpy() for n in ("r", "c", value))))
        return pa.table({"img_id": pa.array([group.column("img_id")[0].as_py()] * len(rows), pa.int64()), **{n: pa.array(rows[:, i].copy()) for i, n in enumerate(SEGMENT)}})

    return px.select("img_id", "r", "c", value).groupby("img_id").applyInArrow(go, "img_id bigint, " + ", ".join(f"{n} double" for n in SEGMENT))


def least_cost(cost: np.ndarray, start: tuple[int, int], goal: tuple[int, int], most: int | None = None) -> tuple[list[tuple[int, int]], float, bool]:
    """(pixels from start to where it ended, their cost, whether that is the goal), by goal-directed search.

    A step costs its length times the cost of the pixel it enters. Pixels cost at least 1, so the
    straight distance never overrates what is left and the first arrival is cheapest. After `most`
    expansions the route to the expanded pixel that is closest to the goal by rows plus columns is
    given. Of pixels that promise the same the one that comes first by column, then by row, is expanded first.
    """
    high, wide = cost.shape
    price, goal_r, goal_c, hypot, push, pop = cost.tolist(), *goal, math.hypot, heapq.heappush, heapq.heappop
    blocks = lambda p: abs(goal_r - p[0]) + abs(goal_c - p[1])
    spent, parent = {start: 0.0}, {}
    queue, done, closest, nearest = [(hypot(goal_r - start[0], goal_c - start[1]), start[1], start[0])], 0, start, blocks(start)
    while queue and (most is None or done < most):
        _, c, r = pop(queue)
        at = (r, c)
        done += 1
        if (b := abs(goal_r - r) + abs(goal_c - c)) < nearest:
            closest, nearest = at, b
        if b == 0:
            break
        base = spent[at]
        for dr, dc, length in STEPS:
            y, x = r + dr, c + dc
            if 0 <= y < high and 0 <= x < wide:
                total, to = base + price[y][x] * length, (y, x)
                if total < spent.get(to, math.inf):
                    spent[to], parent[to] = total, at
                    push(queue, (total + hypot(goal_r - y, goal_c - x), x, y))
    route = [closest]
    while route[-1] in parent:
        route.append(parent[route[-1]])
    return route[::-1], spent[closest], closest == goal


def routes(costs: DataFrame, requests: DataFrame, most: int | None = None, per_block: int | None = 500, with_start: bool = False, partial: bool = True) -> DataFrame:
    """req_id, seq, r, c, total, reached: least-cost routes for requests (req_id, img_id, sr, sc, er, ec) over costs (img_id, r, c, cost).

    most: expansions allowed; with per_block at least 100,000 or per_block times the blocks between
    the ends. Without partial a request that runs out of them has no route. Requests are dealt by
    image and a salt of 16, so that an image with very many requests is not one task.
    """
    from pyspark.sql import functions as F

    def go(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = []
        if left.num_rows and right.num_rows:
            cost = dense(*(right.column(n).to_numpy() for n in ("r", "c", "cost")))
            for q in left.to_pylist():
                start, goal = (q["sr"], q["sc"]), (q["er"], q["ec"])
                limit = most if most is not None else max(100_000, per_block * (abs(start[0] - goal[0]) + abs(start[1] - goal[1]))) if per_block else None
                route, total, reached = least_cost(cost, start, goal, limit)
                if reached or partial:
                    rows += [(q["req_id"], k, r, c, total, reached) for k, (r, c) in enumerate(route) if k or with_start]
        kinds = {"req_id": pa.int64(), "seq": pa.int32(), "r": pa.int32(), "c": pa.int32(), "total": pa.float64(), "reached": pa.bool_()}
        return pa.table({n: pa.array([x[i] for x in rows], t) for i, (n, t) in enumerate(kinds.items())})

    salts = 16
    asked = requests.withColumn("salt", F.pmod(F.xxhash64("req_id"), F.lit(salts)))
    wanted = asked.select(F.col("img_id").alias("of_img"), F.col("salt").alias("of_salt")).distinct()
    spread_costs = costs.select("img_id", "r", "c", "cost").join(wanted, F.col("img_id") == F.col("of_img"))
    return asked.groupby("img_id", "salt").cogroup(spread_costs.groupby("of_img", "of_salt")).applyInArrow(go, "req_id bigint, seq int, r int, c int, total double, reached boolean")


def in_order(mask: np.ndarray, cell: int = 8) -> list[tuple[int, int]]:
    """The on-pixels, from the first by row and column, each followed by the nearest that is left, ties by row and column.

    Pixels lie in square cells; the search goes through rings of cells until none that is nearer can follow. Where
    only few cells are left, all are looked at.
    """
    on = np.argwhere(mask)
    if not len(on):
        return []
    cells: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for r, c in on.tolist():
        cells.setdefault((r // cell, c // cell), []).append((r, c))
    high, wide = mask.shape[0] // cell, mask.shape[1] // cell
    here = (int(on[0][0]), int(on[0][1]))
    out = []
    while True:
        out.append(here)
        i, j = here[0] // cell, here[1] // cell
        cells[i, j].remove(here)
        if not cells[i, j]:
            del cells[i, j]
        if not cells:
            return out
        best = None
        if len(cells) <= 64:  # few cells are left: look at all
            rings = [list(cells)]
        else:
            rings = ([(a, b) for a in range(max(0, i - k), min(high, i + k) + 1) for b in ((j - k, j + k) if abs(a - i) < k and k else range(max(0, j - k), min(wide, j + k) + 1)) if (a, b) in cells] for k in range(max(high, wide) + 1))
        for k, ring in enumerate(rings):
            # A pixel k cells away is at least (k - 1) cells and one pixel away.
            if best and best[0] < ((k - 1) * cell + 1) ** 2:
                break
            for at in ring:
                for r, c in cells[at]:
                    d = (r - here[0]) ** 2 + (c - here[1]) ** 2
                    if best is None or (d, r, c) < best:
                        best = (d, r, c)
        here = best[1:]


def kept_vertices(x: np.ndarray, y: np.ndarray, first: np.ndarray, tolerance: float) -> np.ndarray:
    """Douglas and Peucker: which vertices of lines that begin at the places `first` are farther than tolerance from the chords
    kept so far. A round looks at all chords of all lines at once."""
    ends = np.append(first[1:], len(x)) - 1
    keep = np.zeros(len(x), bool)
    keep[first] = keep[ends] = True
    a, b = first, ends
    while True:
        wide = b - a >= 2
        a, b = a[wide], b[wide]
        if not len(a):
            return keep
        many = b - a - 1
        start = np.cumsum(many) - many
        chord = np.repeat(np.arange(len(a)), many)
        place = np.arange(len(chord))
        inner = (a + 1 - start)[chord] + place
        cx, cy, ix, iy = (x[b] - x[a])[chord], (y[b] - y[a])[chord], x[inner] - x[a][chord], y[inner] - y[a][chord]
        size = np.fromiter(map(math.hypot, (x[b] - x[a]).tolist(), (y[b] - y[a]).tolist()), "f8", len(a))[chord]
        off = np.where(size > 0, np.abs(cx * iy - cy * ix) / np.where(size > 0, size, 1.0), np.hypot(ix, iy))
        most = np.maximum.reduceat(off, start)
        k = np.minimum.reduceat(np.where(off == most[chord], place, len(place)), start)  # the first of equally far ones
        far = most > tolerance
        middle = inner[k[far]]
        keep[middle] = True
        a, b = np.concatenate([a[far], middle]), np.concatenate([middle, b[far]])


def simplify(points: np.ndarray, tolerance: float) -> np.ndarray:
    """One line's vertices that are kept."""
    return points[kept_vertices(points[:, 0], points[:, 1], np.array([0]), tolerance)]


def simplify_lines(points: DataFrame, tolerance: float = 1.0) -> DataFrame:
    """line_id, seq, x, y: each line (line_id, seq, x, y) simplified."""

    def kernel(x: np.ndarray, y: np.ndarray, first: np.ndarray) -> tuple:
        keep = kept_vertices(x, y, first, tolerance)
        return np.add.reduceat(keep.astype("i8"), first), x[keep], y[keep]

    return per_line(points, kernel)


def ordered_pixels(mask: DataFrame) -> DataFrame:
    """img_id, seq, r, c: each mask's pixels in nearest-neighbour order."""

    def go(group: pa.Table) -> pa.Table:
        r, c = (group.column(n).to_numpy() for n in ("r", "c"))
        rows = in_order(dense(r, c, np.ones(len(r), bool)))
        return pa.table({"img_id": pa.array([group.column("img_id")[0].as_py()] * len(rows), pa.int64()), "seq": pa.array(np.arange(len(rows), dtype="i4")), **{n: pa.array([x[i] for x in rows], pa.int32()) for i, n in enumerate(("r", "c"))}})

    return mask.select("img_id", "r", "c").groupby("img_id").applyInArrow(go, "img_id bigint, seq int, r int, c int")
