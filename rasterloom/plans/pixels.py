"""Queries on extents, sizes and pixel coordinates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import coordinates as co
from ..registry import query
from .fixtures import LINE_PTS, POINTS, RASTER, VIEWS, line_pts, points, raster, table, views

#: Caps of a view: pixels of an axis when tracing and when previewing, and the least.
TRACE_MOST, PREVIEW_MOST, VIEW_LEAST, BANDS = 1000, 800, 10, 3
#: The view transform that the point queries use, and its pixel size in map units.
X_MIN, Y_MAX, PX_W, PX_H, WIDTH, HEIGHT = 0.0, 50.0, 0.75, 0.5, 64, 50

CLIP = """clip AS (SELECT view_id, greatest(xmin, rx0) AS x0, greatest(ymin, ry0) AS y0, least(xmax, rx1) AS x1, least(ymax, ry1) AS y1, resolution FROM views
  WHERE greatest(xmin, rx0) < least(xmax, rx1) AND greatest(ymin, ry0) < least(ymax, ry1))"""


def clipped(spark, sf_dir):
    """The part of each view that its raster covers; views without any are dropped."""
    c = F.col
    return views(spark, sf_dir).select(
        "view_id", F.greatest(c("xmin"), c("rx0")).alias("x0"), F.greatest(c("ymin"), c("ry0")).alias("y0"), F.least(c("xmax"), c("rx1")).alias("x1"), F.least(c("ymax"), c("ry1")).alias("y1"), "resolution"
    ).where("x0 < x1 and y0 < y1")


@query("clip_extent", f"WITH {VIEWS}, {CLIP} SELECT view_id, x0, y0, x1, y1 FROM clip")
def clip_extent(spark, sf_dir):
    return clipped(spark, sf_dir).drop("resolution")


SIZE_SQL = "CASE WHEN resolution > 0 THEN greatest({least}, least({most}, round_even(({b} - {a}) / resolution, 0)))::INT ELSE {least} END"


def dims_sql(most):
    return ", ".join(SIZE_SQL.format(a=f"{x}0", b=f"{x}1", least=VIEW_LEAST, most=most) + f" AS {n}" for x, n in (("x", "width"), ("y", "height")))


def sized(spark, sf_dir, most):
    return clipped(spark, sf_dir).select("view_id", *(co.resampled_size(F.col(f"{x}1") - F.col(f"{x}0"), F.col("resolution"), VIEW_LEAST, most).alias(n) for x, n in (("x", "width"), ("y", "height"))))


@query("resample_dims", f"WITH {VIEWS}, {CLIP} SELECT view_id, {dims_sql(TRACE_MOST)} FROM clip")
def resample_dims(spark, sf_dir):
    return sized(spark, sf_dir, TRACE_MOST)


@query("cap_dimension", f"WITH {VIEWS}, {CLIP} SELECT view_id, {dims_sql(60)} FROM clip")
def cap_dimension(spark, sf_dir):
    return sized(spark, sf_dir, 60)


@query("min_view_gate", f"WITH {VIEWS}, {CLIP}, d AS (SELECT view_id, {dims_sql(TRACE_MOST).replace(f'greatest({VIEW_LEAST}, ', 'greatest(1, ')} FROM clip) SELECT * FROM d WHERE width >= {VIEW_LEAST} AND height >= {VIEW_LEAST}")
def min_view_gate(spark, sf_dir):
    """Views of fewer than VIEW_LEAST pixels on an axis yield nothing."""
    c = F.col
    dims = [F.when(c("resolution") > 0, F.greatest(F.lit(1), F.least(F.lit(TRACE_MOST), F.bround((c(f"{x}1") - c(f"{x}0")) / c("resolution"), 0).cast("int")))).otherwise(F.lit(VIEW_LEAST)).alias(n) for x, n in (("x", "width"), ("y", "height"))]
    return clipped(spark, sf_dir).select("view_id", *dims).where(f"width >= {VIEW_LEAST} and height >= {VIEW_LEAST}")


@query("transform_extent", f"WITH {VIEWS} SELECT view_id, round(xmin * 2.0::DOUBLE + 100, 6) AS xmin, round(-ymax * 3.0::DOUBLE, 6) AS ymin, round(xmax * 2.0::DOUBLE + 100, 6) AS xmax, round(-ymin * 3.0::DOUBLE, 6) AS ymax FROM views")
def transform_extent(spark, sf_dir):
    """An extent through an affine map whose second axis is turned around: the corners swap."""
    c = F.col
    return views(spark, sf_dir).select(
        "view_id", F.round(c("xmin") * 2.0 + 100, 6).alias("xmin"), F.round(-c("ymax") * 3.0, 6).alias("ymin"), F.round(c("xmax") * 2.0 + 100, 6).alias("xmax"), F.round(-c("ymin") * 3.0, 6).alias("ymax")
    )


@query("transform_point", f"WITH {POINTS} SELECT pid, CASE WHEN pid % 2 = 0 THEN x ELSE round(x * 2.0::DOUBLE + 100, 6) END AS x, CASE WHEN pid % 2 = 0 THEN y ELSE round(-y * 3.0::DOUBLE, 6) END AS y FROM points")
def transform_point(spark, sf_dir):
    """A point between reference systems; where both are the same it stays as it is."""
    same = F.col("pid") % 2 == 0
    return points(spark, sf_dir).select("pid", F.when(same, F.col("x")).otherwise(F.round(F.col("x") * 2.0 + 100, 6)).alias("x"), F.when(same, F.col("y")).otherwise(F.round(-F.col("y") * 3.0, 6)).alias("y"))


PIXELS = f"{POINTS}, pix AS (SELECT pid, img_id, trunc((x - {X_MIN}::DOUBLE) / {PX_W}::DOUBLE)::INT AS px, trunc(({Y_MAX}::DOUBLE - y) / {PX_H}::DOUBLE)::INT AS py FROM points)"


def pixels(spark, sf_dir):
    px, py = co.map_to_pixel(F.col("x"), F.col("y"), *map(F.lit, (X_MIN, Y_MAX, PX_W, PX_H)))
    return points(spark, sf_dir).select("pid", "img_id", px.alias("px"), py.alias("py"))


@query("map_to_pixel", f"WITH {PIXELS} SELECT pid, px, py FROM pix")
def map_to_pixel(spark, sf_dir):
    return pixels(spark, sf_dir).drop("img_id")


@query("pixel_to_map", f"WITH {PIXELS} SELECT pid, round({X_MIN}::DOUBLE + px * {PX_W}::DOUBLE, 6) AS x, round({Y_MAX}::DOUBLE - py * {PX_H}::DOUBLE, 6) AS y FROM pix")
def pixel_to_map(spark, sf_dir):
    x, y = co.pixel_to_map(F.col("px"), F.col("py"), *map(F.lit, (X_MIN, Y_MAX, PX_W, PX_H)))
    return pixels(spark, sf_dir).select("pid", F.round(x, 6).alias("x"), F.round(y, 6).alias("y"))


@query("in_bounds", f"WITH {PIXELS} SELECT pid FROM pix WHERE px BETWEEN 0 AND {WIDTH - 1} AND py BETWEEN 0 AND {HEIGHT - 1}")
def in_bounds(spark, sf_dir):
    return pixels(spark, sf_dir).where(co.in_bounds(F.col("px"), F.col("py"), F.lit(WIDTH), F.lit(HEIGHT))).select("pid")


@query("clamp_pixel", f"WITH {POINTS} SELECT pid, greatest(0, least({WIDTH - 1}, round_even(x, 0)))::INT AS px, greatest(0, least({HEIGHT - 1}, round_even(y, 0)))::INT AS py FROM points")
def clamp_pixel(spark, sf_dir):
    return points(spark, sf_dir).select("pid", co.clamp_pixel(F.col("x"), F.lit(WIDTH)).alias("px"), co.clamp_pixel(F.col("y"), F.lit(HEIGHT)).alias("py"))


ENDS = f"""{LINE_PTS}, ends AS (SELECT line_id, arg_min(x, seq) AS x1, arg_min(y, seq) AS y1, arg_max(x, seq) AS x2, arg_max(y, seq) AS y2, count(*) AS n FROM line_pts GROUP BY line_id)"""


def ends(spark, sf_dir):
    return line_pts(spark, sf_dir).groupBy("line_id").agg(F.min_by("x", "seq").alias("x1"), F.min_by("y", "seq").alias("y1"), F.max_by("x", "seq").alias("x2"), F.max_by("y", "seq").alias("y2"), F.count(F.lit(1)).alias("n"))


@query("near_start", f"WITH {ENDS} SELECT line_id, sqrt((x1 - x2) * (x1 - x2) + (y1 - y2) * (y1 - y2)) < (CASE WHEN n = 1 THEN 30 ELSE 20 END) * 0.5::DOUBLE AS near FROM ends")
def near_start(spark, sf_dir):
    """Whether the last vertex is back at the first: within 20 pixels, 30 while there is only one."""
    tolerance = F.when(F.col("n") == 1, 30).otherwise(20) * F.lit(0.5)
    return ends(spark, sf_dir).select("line_id", co.near(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"), tolerance).alias("near"))


@query("line_endpoints", f"WITH {ENDS} SELECT line_id, x1, y1, x2, y2 FROM ends")
def line_endpoints(spark, sf_dir):
    return ends(spark, sf_dir).drop("n")


WEIGHT_SQL = "SELECT o_orderkey AS id, (o_custkey % 11) / 10.0::DOUBLE AS w FROM orders"


@query("snap_radius", f"SELECT id, greatest(1, trunc(15.0::DOUBLE * (1.0::DOUBLE - 0.7::DOUBLE * w))::INT) AS radius FROM ({WEIGHT_SQL})")
def snap_radius(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), co.snap_radius((F.col("o_custkey") % 11) / F.lit(10.0)).alias("radius"))


@query("blend_point", f"WITH {POINTS} SELECT pid, round(0.7::DOUBLE * x + 0.3::DOUBLE * floor(x), 6) AS x, round(0.7::DOUBLE * y + 0.3::DOUBLE * floor(y), 6) AS y FROM points")
def blend_point(spark, sf_dir):
    return points(spark, sf_dir).select("pid", *(F.round(co.blend(F.col(c), F.floor(c)), 6).alias(c) for c in ("x", "y")))


@query("heuristic", f"WITH {PIXELS} SELECT pid, round(sqrt((px - 30) * (px - 30) + (py - 20) * (py - 20)), 6) AS h FROM pix")
def heuristic(spark, sf_dir):
    return pixels(spark, sf_dir).select("pid", F.round(F.hypot(F.col("px") - 30, F.col("py") - 20), 6).alias("h"))


@query("scan_raster_bands", f"WITH {RASTER} SELECT img_id, band, r, c, v FROM raster WHERE band <= 3 AND r BETWEEN 5 AND 30 AND c BETWEEN 10 AND 40")
def scan_raster_bands(spark, sf_dir):
    """The samples of an extent, at most BANDS bands."""
    return raster(spark, sf_dir).where(f"band <= {BANDS} and r between 5 and 30 and c between 10 and 40")


@query("cap_bands", "SELECT (vec_id // 50)::BIGINT AS img_id, (c % 5 + 1)::INT AS band, count(*) AS n FROM embeddings, range(64) t(c) WHERE c % 5 < 3 GROUP BY ALL")
def cap_bands(spark, sf_dir):
    return raster(spark, sf_dir).withColumn("band", F.col("c") % 5 + 1).where(f"band <= {BANDS}").groupBy("img_id", "band").agg(F.count(F.lit(1)).alias("n"))


@query("resample_view", f"""WITH {RASTER}, o AS (SELECT i.img_id, y.r::INT AS r, x.c::INT AS c FROM (SELECT DISTINCT img_id FROM raster) i, range(20) y(r), range(30) x(c))
SELECT o.img_id, o.r, o.c, s.v FROM o JOIN raster s ON s.img_id = o.img_id AND s.r = floor((o.r + 0.5::DOUBLE) * 50 / 20)::INT AND s.c = floor((o.c + 0.5::DOUBLE) * 64 / 30)::INT""")
def resample_view(spark, sf_dir):
    """Nearest neighbour to 30 by 20: every output pixel takes the source pixel under its middle."""
    px = raster(spark, sf_dir)
    out = px.select("img_id").distinct().select("img_id", F.explode(F.sequence(F.lit(0), F.lit(19))).alias("r")).select("*", F.explode(F.sequence(F.lit(0), F.lit(29))).alias("c"))
    at = out.withColumns({"sr": F.floor((F.col("r") + 0.5) * 50 / 20).cast("int"), "sc": F.floor((F.col("c") + 0.5) * 64 / 30).cast("int")})
    src = px.select("img_id", F.col("r").alias("sr"), F.col("c").alias("sc"), "v")
    return at.join(src, ["img_id", "sr", "sc"]).select("img_id", "r", "c", "v")
