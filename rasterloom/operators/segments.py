"""Line segments of a view: regions of like gradient direction, found by array passes and held against chance.

Regions are like those of Burns et al. (1986): pixels fall into sectors by the direction of their level line, under a few
sets of sectors turned against each other. Touching pixels of one sector are a region; a pixel goes with the largest of its own.
A region that leaves its box too empty is cut again by narrower sectors, which breaks arcs into straight parts. A box stays
if noise of the view's size is expected to have less than `chance` boxes so full of aligned pixels (von Gioi et al., 2010).
"""

from __future__ import annotations

import math

import numpy as np

#: Half of the widest sector, in degrees, and how often it is halved.
WITHIN, ROUNDS = 22.5, 3
#: Sets of sectors, so that any direction lies near the middle of a sector of one.
SETS = 4
#: The least share of its box that a region fills.
DENSITY = 0.7
#: Boxes expected in noise, and the precisions that the number of tests allows for.
CHANCE, PRECISIONS = 1.0, 11
#: The error of a level; gradients whose direction it can turn by more than WITHIN have none.
LEVEL_ERROR = 2.0

#: Ends along the main axis, width, aligned share of noise, share of the box that is filled, -log10 of the false alarms.
NAMES = ("x1", "y1", "x2", "y2", "width", "prec", "density", "nfa")


def smooth(g: np.ndarray) -> np.ndarray:
    """g under weights 1, 2, 1 along both axes, its border repeated: the steps of a slanting edge become a slope."""
    g = np.pad(g.astype("f8"), 1, "edge")
    g = (g[:-2] + 2 * g[1:-1] + g[2:]) / 4
    return (g[:, :-2] + 2 * g[:, 1:-1] + g[:, 2:]) / 4


def level_lines(g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Strength of the gradient amid each four pixels and the direction of the level line, one row and column less than g."""
    g = smooth(g)
    a, b, c, d = g[:-1, :-1], g[:-1, 1:], g[1:, :-1], g[1:, 1:]
    gx, gy = (b + d - a - c) / 2, (c + d - a - b) / 2
    return np.hypot(gx, gy), np.arctan2(gx, -gy)


def merged(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n nodes the smallest that links (a, b) lead to."""
    root = np.arange(n)
    while True:
        low, high = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
        apart = low != high
        if not apart.any():
            return root
        a, b = a[apart], b[apart]
        np.minimum.at(root, high[apart], low[apart])
        while (root[root] != root).any():
            root = root[root]


def touching(on: np.ndarray, sector: np.ndarray) -> np.ndarray:
    """The region of each on-pixel, in the order of rows: those of one sector that touch over eight neighbours."""
    (h, w), number = on.shape, np.cumsum(on).reshape(on.shape) - 1
    links = []
    for dr, dc in ((0, 1), (1, -1), (1, 0), (1, 1)):
        here = slice(0, h - dr), slice(max(0, -dc), w - max(0, dc))
        there = slice(dr, h), slice(max(0, dc), w - max(0, -dc))
        same = on[here] & on[there] & (sector[here] == sector[there])
        links.append((number[here][same], number[there][same]))
    return merged(int(on.sum()), *(np.concatenate(x) for x in zip(*links)))


def regions(on: np.ndarray, angle: np.ndarray, within: float) -> np.ndarray:
    """The number, from 0, of each on-pixel's region by sectors of twice `within` degrees."""
    many = round(180 / within)
    turn = (angle + math.pi) * many / (2 * math.pi)
    best = size = np.zeros(len(turn[on]), "i8")
    for k in range(SETS):
        region = touching(on, np.floor(turn + k / SETS) % many)
        here = np.bincount(region)[region]
        best, size = np.where(here > size, region + k * len(region), best), np.maximum(here, size)
    return np.unique(best, return_inverse=True)[1]


def boxes(region: np.ndarray, x: np.ndarray, y: np.ndarray, weight: np.ndarray, angle: np.ndarray, within: float) -> dict[str, np.ndarray]:
    """The box around each region along its main axis, how many pixels have room in it and how many are aligned with it."""
    sums = lambda v: np.bincount(region, v)
    total, size = sums(weight), np.bincount(region)
    mx, my = sums(weight * x) / total, sums(weight * y) / total
    dx, dy = x - mx[region], y - my[region]
    axis = np.arctan2(2 * sums(weight * dx * dy), sums(weight * dx * dx) - sums(weight * dy * dy)) / 2
    ux, uy = np.cos(axis), np.sin(axis)
    back = sums(np.cos(angle)) * ux + sums(np.sin(angle)) * uy < 0  # it runs as its level lines do
    ux, uy = np.where(back, -ux, ux), np.where(back, -uy, uy)
    aligned = np.cos(angle) * ux[region] + np.sin(angle) * uy[region] >= math.cos(math.radians(within)) - 1e-12
    along, across = dx * ux[region] + dy * uy[region], dy * ux[region] - dx * uy[region]
    order = np.argsort(region, kind="stable")
    starts = np.cumsum(size) - size
    least, most = (lambda v: np.minimum.reduceat(v[order], starts)), (lambda v: np.maximum.reduceat(v[order], starts))
    t0, t1, width = least(along), most(along), most(across) - least(across) + 1
    area = (t1 - t0 + 1) * width
    between = np.maximum(t1 - t0, 1) * np.maximum(width - 1, 1)  # from centre to centre, for the share that is filled
    return {
        "x1": mx + t0 * ux, "y1": my + t0 * uy, "x2": mx + t1 * ux, "y2": my + t1 * uy, "width": width,
        "density": size / between, "room": np.maximum(np.ceil(area), size).astype("i8"), "aligned": sums(aligned).astype("i8"),
    }


def log_tail(n: int, k: int, p: float, factorials: np.ndarray) -> float:
    """log10 of the chance of k or more of n, each by chance p; factorials: their logarithms up to n."""
    j = np.arange(k, n + 1)
    terms = factorials[n] - factorials[j] - factorials[n - j] + j * math.log(p) + (n - j) * math.log1p(-p)
    return float(terms.max() + math.log(np.exp(terms - terms.max()).sum())) / math.log(10)


def line_segments(g: np.ndarray, chance: float = CHANCE) -> np.ndarray:
    """The segments of a view of levels, a row each with the columns NAMES; places are of pixel centres.

    The dark side is to the right of the way from (x1, y1) to (x2, y2), rows counted downwards. A view of
    one row or column has none, nor has a constant one.
    """
    strength, angle = level_lines(g)
    left = strength >= LEVEL_ERROR / math.sin(math.radians(WITHIN))
    tests = 2.5 * math.log10(max(g.size, 1)) + math.log10(PRECISIONS)
    found = []
    for step in range(ROUNDS):
        if not left.any():
            break
        (r, c), within = np.nonzero(left), WITHIN / 2**step
        region = regions(left, angle, within)
        box = boxes(region, c + 0.5, r + 0.5, strength[r, c], angle[r, c], within)
        full = box["density"] >= DENSITY
        p = within / 180
        factorials = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, box["room"][full].max(initial=0) + 1)))])
        for i in np.flatnonzero(full).tolist():
            nfa = -tests - log_tail(int(box["room"][i]), int(box["aligned"][i]), p, factorials)
            if nfa > -math.log10(chance):
                found.append((*(float(box[n][i]) for n in NAMES[:5]), p, float(box["density"][i]), nfa))
        left[r, c] = ~full[region]
    return np.array(found, "f8").reshape(-1, len(NAMES))
