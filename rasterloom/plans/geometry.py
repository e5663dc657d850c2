"""Queries on line and point layers: building, closing, merging, saving and looking up features."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import lines as ops
from ..registry import query
from .fixtures import LINE_PTS, LINES, SPOTS, line_pts, lines, spots, table

#: Elevations are between these, to one decimal.
ELEVATION_LEAST, ELEVATION_MOST = -1000.0, 10000.0
XS = "list_transform({}, lambda p: p.x)"


def xs(geom):
    """The x values: what the checks compare of a line."""
    return geom["x"].alias("xs")


@query("make_polyline", f"WITH {LINE_PTS} SELECT line_id, list(x ORDER BY seq) AS xs, list(y ORDER BY seq) AS ys FROM line_pts GROUP BY line_id")
def make_polyline(spark, sf_dir):
    return ops.make_polyline(line_pts(spark, sf_dir)).select("line_id", xs(F.col("geom")), F.col("geom")["y"].alias("ys"))


CLOSED_SQL = "CASE WHEN len({p}) < 2 OR {p}[1] = list_last({p}) THEN {p} ELSE list_append({p}, {p}[1]) END"


@query("close_ring", f"WITH {LINES} SELECT fid, {XS.format(CLOSED_SQL.format(p='pts'))} AS xs FROM lines")
def close_ring(spark, sf_dir):
    return lines(spark, sf_dir).select("fid", xs(ops.close_ring(F.col("geom"))))


#: A line's first two thirds are what is stored, and it is drawn on from there.
NEW_SQL = "pts[greatest(len(pts) // 2, 1):len(pts)]"
OLD_SQL = "pts[1:greatest(len(pts) // 2, 1)]"


def parts(spark, sf_dir):
    """old and new: a line cut in its middle, the joint in both."""
    half = F.greatest(F.expr("cast(size(geom) div 2 as int)"), F.lit(1))
    return lines(spark, sf_dir).select("fid", "id", "elevation", F.slice("geom", F.lit(1), half).alias("old"), F.slice("geom", half, F.size("geom") - half + 1).alias("new"))


@query("merge_resume_end", f"WITH {LINES} SELECT fid, {XS.format(f'({OLD_SQL}) || ({NEW_SQL})[2:len({NEW_SQL})]')} AS xs FROM lines")
@query("concat_polyline", f"WITH {LINES} SELECT fid, {XS.format(f'({OLD_SQL}) || ({NEW_SQL})[2:len({NEW_SQL})]')} AS xs FROM lines")
def merge_resume_end(spark, sf_dir):
    return parts(spark, sf_dir).select("fid", xs(ops.merge_at_end(F.col("old"), F.col("new"))))


@query("merge_resume_start", f"WITH {LINES} SELECT fid, {XS.format(f'list_reverse({OLD_SQL})[1:len({OLD_SQL}) - 1] || ({NEW_SQL})')} AS xs FROM lines")
def merge_resume_start(spark, sf_dir):
    """The part before the joint is drawn backward from it, and the stored line follows."""
    return parts(spark, sf_dir).select("fid", xs(ops.merge_at_start(F.col("new"), F.col("old"))))


SAVE_SQL = f"""WITH {LINES}, p AS (SELECT *, {OLD_SQL} AS old, {NEW_SQL} AS new FROM lines WHERE len(pts) >= 2)
SELECT fid, CASE WHEN fid % 3 = 0 THEN NULL WHEN fid % 3 = 1 THEN elevation ELSE elevation END AS elevation,
  {XS.format("CASE WHEN fid % 3 = 0 THEN " + CLOSED_SQL.format(p='pts') + " WHEN fid % 3 = 1 THEN old || new[2:len(new)] ELSE new END")} AS xs FROM p"""


@query("save_line", SAVE_SQL)
def save_line(spark, sf_dir):
    """Lines of two points and more: closed ones become new features without an elevation, resumed ones keep the stored elevation."""
    geom, i = F.col("geom"), F.col("fid")
    both = lines(spark, sf_dir).select("fid", "geom").join(parts(spark, sf_dir), "fid").where(F.size("geom") >= 2)
    saved = F.when(i % 3 == 0, ops.close_ring(geom)).when(i % 3 == 1, ops.merge_at_end(F.col("old"), F.col("new"))).otherwise(F.col("new"))
    return both.select("fid", F.when(i % 3 != 0, F.col("elevation")).alias("elevation"), xs(saved))


@query("build_feature", f"WITH {LINES} SELECT fid, id, elevation, len(pts)::INT AS n FROM lines")
@query("scan_features", f"WITH {LINES} SELECT fid, id, elevation, len(pts)::INT AS n FROM lines")
def build_feature(spark, sf_dir):
    return lines(spark, sf_dir).select("fid", "id", "elevation", F.size("geom").alias("n"))


@query("ensure_field", f"WITH {LINES} SELECT fid, id, elevation, NULL::DOUBLE AS slope FROM lines")
def ensure_field(spark, sf_dir):
    """A field that a layer lacks is added, with nulls."""
    layer = lines(spark, sf_dir).select("fid", "id", "elevation")
    for name, kind in (("elevation", "double"), ("slope", "double")):
        if name not in layer.columns:
            layer = layer.withColumn(name, F.lit(None).cast(kind))
    return layer


@query("append_feature", f"WITH {LINES}, {SPOTS} SELECT fid, elevation FROM lines UNION ALL SELECT -fid, elevation FROM spots")
def append_feature(spark, sf_dir):
    return lines(spark, sf_dir).select("fid", "elevation").unionByName(spots(spark, sf_dir).select((-F.col("fid")).alias("fid"), "elevation"))


@query("spot_height", f"WITH {SPOTS} SELECT fid, x, y, round(least(greatest(elevation, -1000.0::DOUBLE), 10000.0::DOUBLE), 1) AS elevation FROM spots")
def spot_height(spark, sf_dir):
    bounded = F.least(F.greatest("elevation", F.lit(ELEVATION_LEAST)), F.lit(ELEVATION_MOST))
    return spots(spark, sf_dir).select("fid", "x", "y", F.round(bounded, 1).alias("elevation"))


@query("elevation_domain", f"WITH {SPOTS} SELECT fid, CASE WHEN fid % 9 = 0 THEN NULL ELSE floor(CASE WHEN e < -1000 THEN -1000.0::DOUBLE WHEN e > 10000 THEN 10000.0::DOUBLE ELSE e END * 10 + 0.5::DOUBLE) / 10 END AS elevation FROM (SELECT fid, coalesce(CASE WHEN fid % 4 <> 0 THEN elevation * 3 END, 0.0::DOUBLE) AS e FROM spots)")
def elevation_domain(spark, sf_dir):
    """An elevation that was asked for: default 0, inside its domain; NULL where the question was cancelled."""
    e = F.coalesce(F.when(F.col("fid") % 4 != 0, F.col("elevation") * 3), F.lit(0.0))
    held = F.when(e < ELEVATION_LEAST, F.lit(ELEVATION_LEAST)).when(e > ELEVATION_MOST, F.lit(ELEVATION_MOST)).otherwise(e)
    return spots(spark, sf_dir).select("fid", F.when(F.col("fid") % 9 != 0, F.floor(held * 10 + F.lit(0.5)) / 10).alias("elevation"))


@query("lookup_feature", f"WITH {LINES} SELECT fid, id, elevation FROM lines WHERE fid IN (SELECT c_custkey FROM customer)")
def lookup_feature(spark, sf_dir):
    wanted = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("fid"))
    return lines(spark, sf_dir).select("fid", "id", "elevation").join(wanted, "fid", "left_semi")


@query("update_geometry", f"WITH {LINES} SELECT fid, {XS.format('CASE WHEN fid % 10 = 3 THEN list_reverse(pts) ELSE pts END')} AS xs FROM lines")
def update_geometry(spark, sf_dir):
    """Features with a new geometry take it, the others keep theirs."""
    layer = lines(spark, sf_dir).select("fid", "geom")
    new = layer.where("fid % 10 = 3").select("fid", F.reverse("geom").alias("now"))
    return layer.join(new, "fid", "left").select("fid", xs(F.coalesce("now", "geom")))


PARTS_SQL = "CASE WHEN fid % 5 = 0 THEN [] WHEN fid % 5 = 1 THEN [pts, pts[1:1]] ELSE [pts] END"


@query("line_geometry_filter", f"WITH {LINES}, m AS (SELECT fid, {PARTS_SQL} AS parts, CASE WHEN fid % 4 = 0 THEN 'point' ELSE 'line' END AS kind FROM lines) SELECT fid, len(parts[1])::INT AS n FROM m WHERE kind = 'line' AND len(parts) > 0 AND len(parts[1]) > 0")
def line_geometry_filter(spark, sf_dir):
    """Line features that are not empty, with the first part of those that have several."""
    g = F.col("geom")
    empty = F.slice(F.array(g), 1, 0)
    multi = F.when(F.col("fid") % 5 == 0, empty).when(F.col("fid") % 5 == 1, F.array(g, F.slice(g, 1, 1))).otherwise(F.array(g))
    told = lines(spark, sf_dir).select("fid", multi.alias("parts"), F.when(F.col("fid") % 4 == 0, "point").otherwise("line").alias("kind"))
    return told.where("kind = 'line'").select("fid", F.try_element_at("parts", F.lit(1)).alias("first")).where("size(first) > 0").select("fid", F.size("first").alias("n"))


@query("feature_count", f"WITH {LINES} SELECT count(*) AS n, count(*) = 0 AS empty FROM lines")
def feature_count(spark, sf_dir):
    return lines(spark, sf_dir).agg(F.count(F.lit(1)).alias("n"), (F.count(F.lit(1)) == 0).alias("empty"))


LAYERS = "layers AS (SELECT p_partkey AS layer_id, CASE WHEN p_partkey % 3 = 0 THEN 'Spot Heights' ELSE p_name END AS name, CASE WHEN p_size % 2 = 0 THEN 'point' ELSE 'line' END AS geometry FROM part)"


@query("catalog_find_layer", f"WITH {LAYERS} SELECT layer_id, name FROM layers WHERE name = 'Spot Heights' AND geometry = 'point' ORDER BY layer_id LIMIT 1")
@query("first_match", f"WITH {LAYERS} SELECT layer_id, name FROM layers WHERE name = 'Spot Heights' AND geometry = 'point' ORDER BY layer_id LIMIT 1")
def catalog_find_layer(spark, sf_dir):
    """The first layer of a name that holds points."""
    k = F.col("p_partkey")
    layers = table(spark, sf_dir, "part").select(k.alias("layer_id"), F.when(k % 3 == 0, "Spot Heights").otherwise(F.col("p_name")).alias("name"), F.when(F.col("p_size") % 2 == 0, "point").otherwise("line").alias("geometry"))
    return layers.where("name = 'Spot Heights' and geometry = 'point'").orderBy("layer_id").limit(1).select("layer_id", "name")
