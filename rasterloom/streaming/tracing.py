"""Sessions folded with the pixels of their views: routes to the smoothed pointer, snaps to edges.

A view's cost surface and edges are dense arrays of at most operators.kernels.LIMIT pixels an axis. Sessions meet their
view by (view, salt): a view with many events is dealt to as many groups as it has PER_GROUP events, each of
which reads the view once and folds whole sessions, as a session is sequential.

The way from the path's last point to a target: the least-cost route between their pixels (clamped into the view), without
its start, as centred means over five points if there are more than five, in map units, with its corners cut if there are
more than two. Where the search ends before it reaches the target its nearest pixel is the end; where that is the start,
or where the view has no pixels, the way is the target alone.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.kernels import dense, least_cost
from .sessions import EVENT, KEEP, OUT, TIMEOUT, Fold, table_of, tuples_of, with_ends

#: Expansions that a search may always make, and those a pixel of the straight way adds.
LEAST_EXPANSIONS, PER_PIXEL = 100_000, 500
#: Snaps look so many pixels around and draw so far toward the edge; turns above so many degrees are noise.
SNAP, BLEND, TURN = 6, 0.3, 60.0
#: Rounds of corner cutting.
ROUNDS = 3
#: Events of a view for each group that it is dealt to.
PER_GROUP = 20_000


def cut_corners(points: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """An open line with its corners cut at a quarter and three quarters of each edge; ends stay, lines under three points too."""
    for _ in range(rounds if len(points) >= 3 else 0):
        a, b = points[:-1], points[1:]
        inner = np.stack([0.75 * a + 0.25 * b, 0.25 * a + 0.75 * b], 1).reshape(-1, 2)
        points = np.concatenate([points[:1], inner, points[-1:]])
    return points


class View:
    """Pixels of a view: cost and edges, and where they lie on the map (x_min, y_max, pixel width and height)."""

    def __init__(self, cost: np.ndarray | None, edges: np.ndarray | None, x_min: float = 0.0, y_max: float = 0.0, px_w: float = 1.0, px_h: float = 1.0, snap_radius: int = SNAP):
        self.cost, self.edges, self.x_min, self.y_max, self.px_w, self.px_h, self.radius = cost, edges, x_min, y_max, px_w, px_h, max(SNAP, snap_radius)

    def pixel(self, p: tuple[float, float]) -> tuple[int, int]:
        """(row, column), truncated toward zero."""
        return int((self.y_max - p[1]) / self.px_h), int((p[0] - self.x_min) / self.px_w)

    def on_map(self, r, c):
        return self.x_min + c * self.px_w, self.y_max - r * self.px_h

    def route(self, start: tuple[float, float], target: tuple[float, float]) -> list[tuple[float, float]]:
        if self.cost is None or not self.cost.size:
            return [target]
        inside = lambda p: tuple(min(max(v, 0), n - 1) for v, n in zip(self.pixel(p), self.cost.shape))
        a, b = inside(start), inside(target)
        pixels, _, _ = least_cost(self.cost, a, b, max(LEAST_EXPANSIONS, PER_PIXEL * (abs(a[0] - b[0]) + abs(a[1] - b[1]))))
        way = np.array(pixels[1:], "f8").reshape(-1, 2)
        if not len(way):
            return [target]
        if len(way) > 5:
            way = np.stack([way[max(0, k - 2) : k + 3].mean(0) for k in range(len(way))])
        x, y = self.on_map(way[:, 0], way[:, 1])
        return list(zip(x.tolist(), y.tolist()))

    def preview(self, start: tuple[float, float], target: tuple[float, float]) -> list[tuple[float, float]]:
        return [tuple(p) for p in cut_corners(np.array(self.route(start, target), "f8")).tolist()]

    def snap(self, path: list[tuple[float, float]], p: tuple[float, float]) -> tuple[float, float]:
        """p drawn toward the nearest edge pixel, by rows plus columns, that goes on in the path's direction."""
        if self.edges is None:
            return p
        r, c = self.pixel(p)
        high, wide = self.edges.shape
        if not (0 <= r < high and 0 <= c < wide):
            return p
        top, left = max(0, r - self.radius), max(0, c - self.radius)
        rr, cc = np.nonzero(self.edges[top : r + self.radius + 1, left : c + self.radius + 1])
        rr, cc = rr + top, cc + left
        far = np.abs(rr - r) + np.abs(cc - c)
        good = far <= self.radius
        x, y = self.on_map(rr, cc)
        if len(path) >= 2:
            (ox, oy), (qx, qy) = path[-2:]
            ahead = np.arctan2(y - qy, x - qx) - math.atan2(qy - oy, qx - ox)
            good &= np.abs((ahead + math.pi) % (2 * math.pi) - math.pi) <= math.radians(TURN) + 1e-12
        if not good.any():
            return p
        k = np.lexsort((cc[good], rr[good], far[good]))[0]
        return (1 - BLEND) * p[0] + BLEND * float(x[good][k]), (1 - BLEND) * p[1] + BLEND * float(y[good][k])


def trace(events: DataFrame, pixels: DataFrame, layer: DataFrame | None = None, largest: float = 1.0, timeout: int | None = TIMEOUT, keep: int | None = KEEP, per_group: int = PER_GROUP) -> DataFrame:
    """What every event of (session, img_id, ts, event_id, kind, x, y, manual[, unit]) did, with the pixels (img_id, r, c,
    cost, edge[, x_min, y_max, px_w, px_h]) of its view. A session has one view; one without pixels folds without routes."""
    placed = {"x_min": 0.0, "y_max": 0.0, "px_w": 1.0, "px_h": 1.0}
    px = pixels.withColumns({c: F.lit(v) for c, v in placed.items() if c not in pixels.columns}).select("img_id", "r", "c", "cost", "edge", *placed)

    def go(key: tuple, told: pd.DataFrame, seen: pd.DataFrame) -> pd.DataFrame:
        view = None
        if len(seen):
            r, c = seen["r"].to_numpy(), seen["c"].to_numpy()
            view = View(dense(r, c, seen["cost"].to_numpy("f8")), dense(r, c, seen["edge"].to_numpy(bool)), *(float(seen[n].iloc[0]) for n in placed))
        rows, of = [], {}
        for session, event in zip(told["session"].tolist(), tuples_of(told)):
            of.setdefault(int(session), []).append(event)
        for session in sorted(of):
            fold = Fold(session, timeout=timeout, keep=keep, view=view)
            rows += fold.run(of[session]) + fold.pass_time(math.inf)
        return table_of(rows)

    dealt = events.groupBy("img_id").agg(F.ceil(F.count(F.lit(1)) / per_group).alias("groups"))
    salted = with_ends(events, layer, largest).join(dealt, "img_id").withColumn("salt", F.pmod(F.xxhash64("session"), "groups"))
    wanted = dealt.select(F.col("img_id").alias("of"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("groups") - 1)).alias("of_salt"))
    spread = px.join(wanted, F.col("img_id") == F.col("of"))
    return salted.select("img_id", "salt", "session", *EVENT).groupBy("img_id", "salt").cogroup(spread.drop("img_id").groupBy("of", "of_salt")).applyInPandas(go, OUT)
