"""Queries that snap points to edges and to line ends: bounded nearest-neighbour joins as equi-joins.

Points meet the pixels of their image by key; line ends are met in grid cells of the tolerance's size.
No range join is planned.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.snap import nearest_endpoint, nearest_in_rings, snap_to_edge
from ..registry import query
from .fixtures import MASK, gray, mask, table
from .pixels import ENDS, ends

#: Pointer positions for the snaps: one event a position, on the images of the raster.
AT = """spot AS (SELECT event_id AS pid, event_id % 10 AS img_id, (event_id * 7 % 64)::INT AS px, (event_id * 13 % 50)::INT AS py, (event_id * 5 % 64)::INT AS qx, (event_id * 11 % 50)::INT AS qy, CASE WHEN event_id % 8 > 0 THEN (event_id * 3 % 64)::INT END AS ox, CASE WHEN event_id % 8 > 0 THEN (event_id * 17 % 50)::INT END AS oy FROM events)"""


def positions(spark, sf_dir):
    """pid, img_id, the pixel (px, py), and the path points before it: (qx, qy) and, if there are two, (ox, oy)."""
    e = F.col("event_id")
    known = lambda n, v: F.when(e % 8 > 0, v) if n[0] == "o" else v
    return table(spark, sf_dir, "events").select(
        e.alias("pid"), (e % 10).alias("img_id"), *(known(n, (e * k % m).cast("int")).alias(n) for n, k, m in (("px", 7, 64), ("py", 13, 50), ("qx", 5, 64), ("qy", 11, 50), ("ox", 3, 64), ("oy", 17, 50)))
    )


def offsets_sql(radius: int) -> str:
    return f"(SELECT dy::INT AS dy, dx::INT AS dx FROM range(-{radius}, {radius} + 1) a(dy), range(-{radius}, {radius} + 1) b(dx))"


#: How far the nearest active pixel may lie; and for the middle edge weight of 0.5 the snap radius
#: int(15 (1 - 0.7 weight)) = 9, which the angle-constrained snap has at 6 at least and the gentle one at 5 at most.
NEAREST, SNAP = 20, 9
ANGLED, GENTLE = max(6, SNAP), max(1, min(5, SNAP))

RINGS = f"""WITH {MASK}, {AT}, met AS (
  SELECT pid, m.r, m.c, greatest(abs(dy), abs(dx)) AS ring, dy * dy + dx * dx AS d2 FROM spot, {offsets_sql(NEAREST)} o JOIN mask m ON m.img_id = spot.img_id AND m.r = spot.py + dy AND m.c = spot.px + dx)
SELECT pid, arg_min(c, (ring, d2, r, c)) AS c, arg_min(r, (ring, d2, r, c)) AS r FROM met GROUP BY pid"""


@query("nearest_active_pixel", RINGS)
def nearest_active_pixel(spark, sf_dir):
    """The on-pixel in the nearest square ring within 20, then the closest there."""
    return nearest_in_rings(positions(spark, sf_dir), mask(spark, sf_dir), NEAREST).select("pid", "c", "r")


@query("argmin_candidate", RINGS)
def argmin_candidate(spark, sf_dir):
    return nearest_active_pixel(spark, sf_dir)


def snap_sql(radius: int, angle: bool, stay: bool) -> str:
    turn = "t - h" if angle else "0.0::DOUBLE"
    return f"""WITH {MASK}, {AT}, met AS (
  SELECT pid, px, py, dy, dx, ox, atan2(spot.py - spot.qy, spot.px - spot.qx) AS h0, atan2(spot.qy - spot.oy, spot.qx - spot.ox) AS h, atan2(spot.py + dy - spot.qy, spot.px + dx - spot.qx) AS t
  FROM spot, {offsets_sql(radius)} o JOIN mask m ON m.img_id = spot.img_id AND m.r = spot.py + dy AND m.c = spot.px + dx WHERE abs(dy) + abs(dx) < {radius + 1}
), w AS (SELECT *, {turn} AS d FROM met), g AS (
  SELECT pid, arg_min({{'dx': dx, 'dy': dy}}, (abs(dy) + abs(dx), dy, dx)) AS b FROM w WHERE {"ox IS NULL OR" if angle else ""} abs(CASE WHEN d > pi() THEN d - 2 * pi() WHEN d < -pi() THEN d + 2 * pi() ELSE d END) <= radians(60.0::DOUBLE) GROUP BY pid)
SELECT spot.pid, round(CASE WHEN b IS NULL {"OR (b.dx = 0 AND b.dy = 0)" if stay else ""} THEN px ELSE 0.7::DOUBLE * px + 0.3::DOUBLE * (px + b.dx) END, 6) AS x, round(CASE WHEN b IS NULL {"OR (b.dx = 0 AND b.dy = 0)" if stay else ""} THEN py ELSE 0.7::DOUBLE * py + 0.3::DOUBLE * (py + b.dy) END, 6) AS y FROM spot LEFT JOIN g ON g.pid = spot.pid"""


@query("angle_constrained_snap", snap_sql(ANGLED, True, False))
def angle_constrained_snap(spark, sf_dir):
    """Drawn toward the nearest edge pixel (Manhattan) whose direction turns by at most 60 degrees; any, while the path has one point."""
    return snap_to_edge(positions(spark, sf_dir), mask(spark, sf_dir), ANGLED, turn=60.0).select("pid", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@query("gentle_snap", snap_sql(GENTLE, False, True))
def gentle_snap(spark, sf_dir):
    """Drawn toward the nearest edge pixel; a point on an edge stays."""
    return snap_to_edge(positions(spark, sf_dir), mask(spark, sf_dir), GENTLE).select("pid", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


TOLERANCE = 0.5

ENDPOINT_SQL = f"""WITH {ENDS}, e AS (
  SELECT line_id, x1 AS ex, y1 AS ey, true AS is_start FROM ends UNION ALL SELECT line_id, x2, y2, false FROM ends
), q AS (SELECT c_custkey AS pid, (c_custkey % 50 + 1)::DOUBLE AS x, (c_custkey % 97)::DOUBLE AS y FROM customer), met AS (
  SELECT pid, line_id, is_start, ex, ey, sqrt((ex - x) * (ex - x) + (ey - y) * (ey - y)) AS d FROM q JOIN e ON ex BETWEEN x - {TOLERANCE} AND x + {TOLERANCE} AND ey BETWEEN y - {TOLERANCE} AND y + {TOLERANCE})
SELECT pid, b.line_id AS line_id, b.is_start AS is_start FROM (
  SELECT pid, arg_min({{'line_id': line_id, 'is_start': is_start}}, (d, line_id, (NOT is_start)::INT)) AS b FROM met WHERE d < {TOLERANCE} GROUP BY pid)"""


@query("endpoint_snap", ENDPOINT_SQL)
def endpoint_snap(spark, sf_dir):
    """The nearest end of a line within the tolerance; ties go to the earlier line and to its start."""
    k = F.col("c_custkey")
    asked = table(spark, sf_dir, "customer").select(k.alias("pid"), (k % 50 + 1).cast("double").alias("x"), (k % 97).cast("double").alias("y"))
    told = ends(spark, sf_dir)
    end = lambda k, start: F.struct(F.col(f"x{k}").alias("ex"), F.col(f"y{k}").alias("ey"), F.lit(start).alias("is_start"))
    both = told.select("line_id", F.explode(F.array(end(1, True), end(2, False))).alias("e")).select("line_id", "e.*")
    return nearest_endpoint(asked, both, TOLERANCE).select("pid", "line_id", "is_start")


@query("mask_and_edges", f"WITH {MASK} SELECT img_id, r, c FROM mask WHERE (img_id, r, c) IN (SELECT img_id, r, c FROM gray WHERE g % 2 = 0)")
def mask_and_edges(spark, sf_dir):
    even = gray(spark, sf_dir).where("g % 2 = 0").select("img_id", "r", "c")
    return mask(spark, sf_dir).join(even, ["img_id", "r", "c"], "left_semi")


@query("mask_union", f"WITH {MASK} SELECT img_id, r, c FROM mask UNION SELECT img_id, r, c FROM gray WHERE g < 60")
@query("bitwise_or_masks", f"WITH {MASK} SELECT img_id, r, c FROM mask UNION SELECT img_id, r, c FROM gray WHERE g < 60")
def mask_union(spark, sf_dir):
    from ..operators.raster import union_masks

    return union_masks(mask(spark, sf_dir), gray(spark, sf_dir).where("g < 60"))


SWITCH = f"WITH {AT} SELECT pid, CASE WHEN pid % 4 = 0 OR pid % 3 = 0 OR pid % 11 = 0 THEN px ELSE qx END AS x FROM spot"


@query("freehand_switch", SWITCH)
def freehand_switch(spark, sf_dir):
    """The raw point when drawing freehand, with the manual key held, or without a cached view; else the snapped one."""
    p = F.col("pid")
    freehand, manual, uncached = p % 4 == 0, p % 3 == 0, p % 11 == 0
    return positions(spark, sf_dir).select("pid", F.when(freehand | manual | uncached, F.col("px")).otherwise(F.col("qx")).alias("x"))
