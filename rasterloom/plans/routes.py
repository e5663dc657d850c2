"""Queries on least-cost routes over pixel grids, prompts and mask centre lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import kernels, lines as line_ops
from ..operators.portals import least_costs
from ..operators.snap import nearest_in_rings
from ..registry import query
from . import rasters
from .fixtures import EVENTS, GRAY, WHOLE, gray, line_pts, mask, pointer_events, table
from .snapping import NEAREST

COSTS = f"{GRAY}, costs AS (SELECT img_id, r, c, 1.0::DOUBLE + g / 16.0::DOUBLE AS cost FROM gray)"


def costs(spark, sf_dir):
    return gray(spark, sf_dir).select("img_id", "r", "c", (F.lit(1.0) + F.col("g") / F.lit(16.0)).alias("cost"))


def requests(spark, sf_dir, px=None):
    """Routes asked for: from the corner (0, 0) of each view (of px) to four pixels of it."""
    images = (costs(spark, sf_dir) if px is None else px).groupBy("img_id").agg(F.max("r").alias("h"), F.max("c").alias("w"))
    goal = images.select("img_id", "h", "w", F.explode(F.array(*(F.lit(k) for k in range(4)))).alias("k"))
    return goal.select(
        (F.col("img_id") * 4 + F.col("k")).alias("req_id"), "img_id", F.lit(0).alias("sr"), F.lit(0).alias("sc"),
        F.when(F.col("k") == 0, F.col("h")).when(F.col("k") == 1, F.lit(0)).otherwise(F.least(F.col("h"), F.col("k") * 4)).alias("er"), F.when(F.col("k") == 2, F.lit(3)).otherwise(F.col("w")).alias("ec"),
    )


@query("grid_neighbors", f"""WITH {COSTS} SELECT a.img_id, a.r, a.c, b.r AS to_r, b.c AS to_c, round(CASE WHEN a.r <> b.r AND a.c <> b.c THEN sqrt(2.0::DOUBLE) ELSE 1.0::DOUBLE END * b.cost, 6) AS step
FROM costs a JOIN costs b ON a.img_id = b.img_id AND b.r BETWEEN a.r - 1 AND a.r + 1 AND b.c BETWEEN a.c - 1 AND a.c + 1 AND (a.r <> b.r OR a.c <> b.c)""")
def grid_neighbors(spark, sf_dir):
    """The edges of the grid graph: eight neighbours of every pixel, with the cost of the step."""
    px = costs(spark, sf_dir)
    ring = F.array(*(F.struct(F.lit(dr).alias("dr"), F.lit(dc).alias("dc"), F.lit(length).alias("length")) for dr, dc, length in kernels.STEPS))
    sent = px.select("img_id", "r", "c", F.explode(ring).alias("o")).select("img_id", "r", "c", (F.col("r") + F.col("o.dr")).alias("to_r"), (F.col("c") + F.col("o.dc")).alias("to_c"), "o.length")
    there = px.select("img_id", F.col("r").alias("to_r"), F.col("c").alias("to_c"), "cost")
    return sent.join(there, ["img_id", "to_r", "to_c"]).select("img_id", "r", "c", "to_r", "to_c", F.round(F.col("length") * F.col("cost"), 6).alias("step"))


ASTAR = f"""WITH RECURSIVE {COSTS}, d(img_id, r, c, total) USING KEY (img_id, r, c) AS (
  SELECT img_id, 0, 0, 0.0::DOUBLE FROM (SELECT DISTINCT img_id FROM costs)
  UNION SELECT n.img_id, n.r, n.c, min(d.total + CASE WHEN n.r <> d.r AND n.c <> d.c THEN sqrt(2.0::DOUBLE) ELSE 1.0::DOUBLE END * n.cost)
  FROM d JOIN costs n ON n.img_id = d.img_id AND n.r BETWEEN d.r - 1 AND d.r + 1 AND n.c BETWEEN d.c - 1 AND d.c + 1 LEFT JOIN recurring.d k ON k.img_id = n.img_id AND k.r = n.r AND k.c = n.c
  WHERE k.total IS NULL OR d.total + CASE WHEN n.r <> d.r AND n.c <> d.c THEN sqrt(2.0::DOUBLE) ELSE 1.0::DOUBLE END * n.cost < k.total - 1e-12::DOUBLE GROUP BY n.img_id, n.r, n.c
), ext AS (SELECT img_id, max(r) AS h, max(c) AS w FROM costs GROUP BY img_id), q AS (
  SELECT img_id * 4 + k AS req_id, img_id, CASE k WHEN 0 THEN h WHEN 1 THEN 0 ELSE least(h, k * 4) END AS er, CASE k WHEN 2 THEN 3 ELSE w END AS ec FROM ext, range(4) t(k))
SELECT req_id, round(total, 5) AS total FROM q JOIN d ON d.img_id = q.img_id AND d.r = q.er AND d.c = q.ec WHERE q.er > 0 OR q.ec > 0"""


@query("astar_cost", ASTAR)
def astar_cost(spark, sf_dir):
    found = kernels.routes(costs(spark, sf_dir), requests(spark, sf_dir))
    return found.groupBy("req_id").agg(F.round(F.max("total"), 5).alias("total"))


@query("tiled_cost", ASTAR.replace(GRAY, WHOLE))
def tiled_cost(spark, sf_dir):
    """astar_cost in one image that no task holds whole."""
    px = rasters.whole_gray(spark, sf_dir).select("img_id", "r", "c", (F.lit(1.0) + F.col("g") / F.lit(16.0)).alias("cost"))
    found = least_costs(px, requests(spark, sf_dir, px).where("er > 0 or ec > 0"), 64)
    return found.select("req_id", F.round("total", 5).alias("total"))


@query("path_cost", ASTAR)
def path_cost(spark, sf_dir):
    """The cost of each route, added up over its pixels: what the search reported, found again by a join."""
    found = kernels.routes(costs(spark, sf_dir), requests(spark, sf_dir), with_start=True).join(requests(spark, sf_dir).select("req_id", "img_id"), "req_id")
    from pyspark.sql import Window

    along = Window.partitionBy("req_id").orderBy("seq")
    met = found.join(costs(spark, sf_dir), ["img_id", "r", "c"]).withColumns({"dr": F.col("r") - F.lag("r").over(along), "dc": F.col("c") - F.lag("c").over(along)})
    return met.where("dr is not null").groupBy("req_id").agg(F.round(F.sum(F.sqrt(F.col("dr") * F.col("dr") + F.col("dc") * F.col("dc")) * F.col("cost")), 5).alias("total"))


@query("astar_path")
def astar_path(spark, sf_dir):
    """Routes without their start, partial ones where the expansions allowed run out."""
    return kernels.routes(costs(spark, sf_dir), requests(spark, sf_dir))


@query("astar_standalone")
def astar_standalone(spark, sf_dir):
    """Routes with their start; none where 50,000 expansions do not reach."""
    return kernels.routes(costs(spark, sf_dir), requests(spark, sf_dir), most=50_000, with_start=True, partial=False)


@query("priority_frontier")
def priority_frontier(spark, sf_dir):
    """Where a search of only twelve expansions got to."""
    return kernels.routes(costs(spark, sf_dir), requests(spark, sf_dir), most=12).where("not reached")


@query("path_reconstruct", "WITH RECURSIVE t AS (SELECT c_custkey AS leaf, c_custkey AS node, 0 AS depth FROM customer UNION ALL SELECT leaf, node // 3, depth + 1 FROM t WHERE node > 0) SELECT leaf, depth, node FROM t")
def path_reconstruct(spark, sf_dir):
    """From each leaf back along the parents (node, node div 3) to the root. A leaf's way has as many steps as there are powers
    of 3 up to it, so each leaf gives its own rows: no recursion, whose rows Spark limits, and no round of joins a step."""
    leaf, powers = F.col("c_custkey"), F.array(*(F.lit(3**k).cast("bigint") for k in range(40)))  # 3**39 is the last below 2**63
    steps = F.size(F.filter(powers, lambda p: p <= leaf))
    walked = table(spark, sf_dir, "customer").select(leaf.alias("leaf"), F.explode(F.sequence(F.lit(0), steps)).alias("depth"))
    return walked.withColumn("power", F.get(powers, F.col("depth"))).select("leaf", "depth", F.expr("if(power is null, 0, leaf div power)").alias("node"))


NEAR2 = "len(list_filter({0}, lambda q: (q.x - {1}) * (q.x - {1}) + (q.y - {2}) * (q.y - {2}) < 9)) > 0"
#: The target is a session's last event and the path what comes before; the view is VIEW pixels wide and high.
VIEW = 300
PROMPTS_SQL = f"""WITH RECURSIVE {EVENTS}, ranked AS (SELECT session, x, y, row_number() OVER (PARTITION BY session ORDER BY ts DESC, event_id DESC) AS back FROM pointer),
last4 AS (SELECT session, trunc(x)::INT AS px, trunc(y)::INT AS py, 5 - back AS n FROM ranked WHERE back <= 4),
target AS (SELECT session FROM last4 WHERE n = 4 AND px BETWEEN 0 AND {VIEW - 1} AND py BETWEEN 0 AND {VIEW - 1}),
f AS (SELECT session, 0 AS n, []::STRUCT(x INT, y INT)[] AS kept FROM target
  UNION ALL SELECT f.session, f.n + 1, CASE WHEN l.px IS NULL OR l.px NOT BETWEEN 0 AND {VIEW - 1} OR l.py NOT BETWEEN 0 AND {VIEW - 1} OR {NEAR2.format("f.kept", "l.px", "l.py")} THEN f.kept ELSE list_append(f.kept, {{'x': l.px, 'y': l.py}}) END
  FROM f LEFT JOIN last4 l ON l.session = f.session AND l.n = f.n + 1 WHERE f.n < 4),
b AS (SELECT session, kept, len(kept)::INT AS positives, kept[len(kept) - 1] AS a, list_last(kept) AS z FROM f WHERE n = 4 AND len(kept) >= 2),
v AS (SELECT *, -(z.y - a.y) / sqrt((z.x - a.x) * (z.x - a.x) + (z.y - a.y) * (z.y - a.y)) AS vx, (z.x - a.x) / sqrt((z.x - a.x) * (z.x - a.x) + (z.y - a.y) * (z.y - a.y)) AS vy FROM b),
g AS (SELECT session, positives, 0 AS i, kept, [{{'x': round_even(a.x - vx * 10, 0)::INT, 'y': round_even(a.y - vy * 10, 0)::INT}}, {{'x': round_even(a.x + vx * 10, 0)::INT, 'y': round_even(a.y + vy * 10, 0)::INT}},
    {{'x': round_even(z.x - vx * 10, 0)::INT, 'y': round_even(z.y - vy * 10, 0)::INT}}, {{'x': round_even(z.x + vx * 10, 0)::INT, 'y': round_even(z.y + vy * 10, 0)::INT}}] AS near FROM v
  UNION ALL SELECT session, positives, i + 1, CASE WHEN near[i + 1].x NOT BETWEEN 0 AND {VIEW - 1} OR near[i + 1].y NOT BETWEEN 0 AND {VIEW - 1} OR {NEAR2.format("kept", "near[i + 1].x", "near[i + 1].y")} THEN kept ELSE list_append(kept, near[i + 1]) END, near FROM g WHERE i < 4)
SELECT session, positives, list_transform(kept, lambda p: p.x) AS xs, list_transform(kept, lambda p: p.y) AS ys FROM g WHERE i = 4"""


def prompts(path, target, width: int, height: int):
    """The prompts of a path's last three points and a target, in order and three pixels apart: first the positive
    ones, then ten pixels off the course on both sides of the last two. Null without two positive ones in the view."""
    kind = "array<struct<x:int,y:int>>"

    def accept(kept, p):
        inside = (p["x"] >= 0) & (p["x"] < width) & (p["y"] >= 0) & (p["y"] < height)
        near = F.exists(kept, lambda q: (q["x"] - p["x"]) * (q["x"] - p["x"]) + (q["y"] - p["y"]) * (q["y"] - p["y"]) < 9)
        return F.when(inside & ~near, F.array_append(kept, p)).otherwise(kept)

    positive = F.aggregate(F.array_append(F.slice(path, F.greatest(F.size(path) - 2, F.lit(1)), 3), target).cast(kind), F.array().cast(kind), accept)

    def negatives(kept):
        a, z = F.element_at(kept, -2), F.element_at(kept, -1)
        dx, dy = z["x"] - a["x"], z["y"] - a["y"]
        norm = F.sqrt((dx * dx + dy * dy).cast("double"))
        at = lambda p, sign: F.struct(F.bround(p["x"] + -dy / norm * 10 * sign, 0).cast("int").alias("x"), F.bround(p["y"] + dx / norm * 10 * sign, 0).cast("int").alias("y"))
        return F.array(*(at(p, sign) for p in (a, z) for sign in (-1, 1)))

    inside = (target["x"] >= 0) & (target["x"] < width) & (target["y"] >= 0) & (target["y"] < height)
    return positive, inside, lambda kept: F.aggregate(negatives(kept), kept, accept)


@query("sam_prompts", PROMPTS_SQL)
def sam_prompts(spark, sf_dir):
    """Positive prompts from the last positions and the target, then negative ones off the course; sessions with two positive ones."""
    point = lambda p: F.struct(p["x"].cast("int").alias("x"), p["y"].cast("int").alias("y"))
    seen = F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id", "x", "y"))), point)
    told = pointer_events(spark, sf_dir).groupBy("session").agg(seen.alias("seen"))
    positive, inside, complete = prompts(F.slice("seen", F.lit(1), F.size("seen") - 1), F.element_at("seen", -1), VIEW, VIEW)
    kept = told.where(inside).withColumn("positive", positive).where("size(positive) >= 2").withColumn("kept", complete(F.col("positive")))
    return kept.select("session", F.size("positive").alias("positives"), F.col("kept")["x"].alias("xs"), F.col("kept")["y"].alias("ys"))


def mask_route(asked, mask_costs, centre, outside):
    """Routes over the cost surface of a mask between the pixels of its centre line (img_id, r, c) that are nearest to start
    and goal, within 20; where one has none, of the mask. None without both, and none where the goal is not reached. A route
    so ends at the pixel nearest to its goal."""
    ends = asked.select("img_id", F.explode(F.array(F.struct((F.col("req_id") * 2).alias("pid"), F.col("sr").alias("py"), F.col("sc").alias("px")), F.struct((F.col("req_id") * 2 + 1).alias("pid"), F.col("er").alias("py"), F.col("ec").alias("px")))).alias("e")).select("img_id", "e.*")
    inside = mask_costs.where(F.col("cost") < outside)

    def both(pixels):
        near = nearest_in_rings(ends, pixels, NEAREST).select(F.expr("pid div 2").alias("req_id"), (F.col("pid") % 2).alias("goal"), "r", "c")
        told = near.groupBy("req_id").agg(*(F.max(F.when(F.col("goal") == k, F.col(c))).alias(n) for k, c, n in ((0, "r", "sr"), (0, "c", "sc"), (1, "r", "er"), (1, "c", "ec"))))
        return told.where("sr is not null and er is not null")

    line, body = both(centre), both(inside)
    found = line.unionByName(body.join(line, "req_id", "left_anti")).join(asked.select("req_id", "img_id"), "req_id")
    return kernels.routes(mask_costs, found, partial=False)


@query("sam_path")
def sam_path(spark, sf_dir):
    return mask_route(requests(spark, sf_dir), rasters.sam_cost_map(spark, sf_dir), rasters.mask_lines(spark, sf_dir), rasters.MASK_COSTS[0])


def way(asked, first, second):
    """req_id, path, by: the first route of a request that has one, by what was found; else the goal alone."""
    gather = lambda found, name: found.groupBy("req_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "r", "c"))), lambda p: F.struct(p["r"].alias("r"), p["c"].alias("c"))).alias(name))
    alone = F.array(F.struct(F.col("er").alias("r"), F.col("ec").alias("c")))
    met = asked.join(gather(first, "mask"), "req_id", "left").join(gather(second, "edge"), "req_id", "left")
    by = F.when(F.col("mask").isNotNull(), "mask").when(F.col("edge").isNotNull(), "edge").otherwise("goal")
    return met.select("req_id", F.coalesce("mask", "edge", alone).alias("path"), by.alias("by"))


@query("optimal_path")
def optimal_path(spark, sf_dir):
    """The mask's route where there is one, else the edge cost's, partial where its search ends early, else the goal alone."""
    asked = requests(spark, sf_dir)
    return way(asked, sam_path(spark, sf_dir), astar_path(spark, sf_dir))


@query("nn_order")
def nn_order(spark, sf_dir):
    return kernels.ordered_pixels(mask(spark, sf_dir))


@query("mask_to_line")
def mask_to_line(spark, sf_dir):
    """A mask's centre line as a polyline, simplified; nothing from fewer than two pixels."""
    px = mask(spark, sf_dir).withColumn("g", F.lit(1))
    pixels = kernels.ordered_pixels(kernels.per_image(px, "g", kernels.thin))
    lines = pixels.select(F.col("img_id").alias("line_id"), "seq", F.col("c").cast("double").alias("x"), F.col("r").cast("double").alias("y"))
    many = lines.groupBy("line_id").count().where("count >= 2")
    return kernels.simplify_lines(lines.join(many, "line_id", "left_semi"), 1.0)


@query("simplify_line")
def simplify_line(spark, sf_dir):
    return kernels.simplify_lines(line_pts(spark, sf_dir), 5.0)
