"""Queries that write and read layers, rasters, manifests and reports."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..registry import query
from ..sources import layers, tiled_raster
from .fixtures import MASK, RASTER, gray, lines, mask, raster, spots, table, weights


def folder(spark, name):
    """A new path in the folder that driver and executors share."""
    return f"{layers.shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@query("decode_block", "SELECT (vec_id // 50)::BIGINT AS img_id, (vec_id % 50)::INT AS r, c::INT AS c, floor(embedding[c + 1]::DOUBLE * 1000)::DOUBLE AS v FROM embeddings, range(64) t(c)")
def decode_block(spark, sf_dir):
    """Rows of an image as raw 16-bit blocks, decoded again."""
    px = raster(spark, sf_dir).withColumn("n", F.floor(F.col("v") * 1000).cast("int"))
    two = F.hex((F.col("n") + 65536) % 65536)
    word = F.lpad(two, 4, "0")
    little = F.concat(F.substring(word, 3, 2), F.substring(word, 1, 2))
    rows = px.select("img_id", "r", "c", little.alias("h")).groupBy("img_id", "r").agg(F.array_sort(F.collect_list(F.struct("c", "h"))).alias("s"), F.count(F.lit(1)).cast("int").alias("width"))
    blocks = rows.select((F.col("img_id") * 1000 + F.col("r")).alias("img_id"), "width", F.lit(1).alias("height"), F.lit("i16").alias("held"), F.unhex(F.array_join(F.transform("s", lambda x: x["h"]), "")).alias("data"))
    return layers.decode_blocks(blocks).select(F.expr("img_id div 1000").alias("img_id"), (F.col("img_id") % 1000).cast("int").alias("r"), "c", "v")


@query("sink_memory_lines")
def sink_memory_lines(spark, sf_dir):
    """An empty layer, and what is appended to it."""
    return layers.memory_layer(spark).unionByName(lines(spark, sf_dir))


@query("sink_line_file", """SELECT o_orderkey::INT AS id, round(o_totalprice / 100, 1) AS elevation, 'EPSG:4326' AS crs, n::INT AS vertices
FROM orders JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY l_orderkey) ON l_orderkey = o_orderkey""")
def sink_line_file(spark, sf_dir):
    """A line layer written as GeoJSON in a named reference system, and read back."""
    path = folder(spark, "lines")
    layers.write_geojson(lines(spark, sf_dir), path, "EPSG:4326")
    return layers.read_geojson(spark, path).select("id", "elevation", "crs", F.size("geom").alias("vertices"))


@query("sink_spots", "SELECT c_custkey AS fid, c_nationkey::DOUBLE AS x, (c_custkey % 100)::DOUBLE AS y, c_acctbal AS elevation FROM customer")
def sink_spots(spark, sf_dir):
    """The spot layer is made when it is first asked for; the second half of the spots finds it with the first."""
    path, told = folder(spark, "spots"), spots(spark, sf_dir)
    for half in (0, 1):
        layer = layers.get_or_create_layer(spark, path, layers.SPOT_LAYER)
        kept = layers.append_to_layer(layer, told.where(F.pmod("fid", F.lit(2)) == half), path)
    return kept


@query("sink_edge_raster", f"WITH {MASK} SELECT img_id, r, c, 255 AS value, [0.0::DOUBLE, 50.0::DOUBLE, 1.0::DOUBLE, 1.0::DOUBLE] AS transform FROM mask")
def sink_edge_raster(spark, sf_dir):
    """An edge raster written in tiles, its transform once, and read back."""
    path = folder(spark, "edges")
    tiled_raster.write_raster(mask(spark, sf_dir).withColumn("v", F.lit(255)), path, held="u8", transform=(0.0, 50.0, 1.0, 1.0), tile=32)
    transform = F.array(*map(F.lit, tiled_raster.geometry_of(spark, path).first()["transform"]))  # told once, by the one write
    return tiled_raster.read_raster(spark, path).where("v > 0").select("img_id", "r", "c", F.col("v").cast("int").alias("value"), transform.alias("transform"))


@query("scan_raster_extent", f"WITH {RASTER} SELECT img_id, r, c, v::FLOAT::DOUBLE AS v FROM raster WHERE r BETWEEN 10 AND 29 AND c BETWEEN 5 AND 40")
def scan_raster_extent(spark, sf_dir):
    """The pixels of an extent, of all images, read from the tiles that it meets."""
    path = folder(spark, "raster")
    tiled_raster.write_raster(raster(spark, sf_dir), path, transform=(0.0, 50.0, 1.0, 1.0), tile=16)
    return tiled_raster.read_raster(spark, path, extent=(5.0, 20.0, 41.0, 40.0))


def files(spark, sf_dir):
    """A folder of written files, for manifests: gray levels by image."""
    path = folder(spark, "release")
    gray(spark, sf_dir).groupBy("img_id").agg(F.to_json(F.array_sort(F.collect_list(F.struct("r", "c", "g")))).alias("value")).select("value", F.concat(F.lit("i"), "img_id").alias("name")).write.partitionBy("name").text(path)
    return path


@query("release_manifest")
def release_manifest(spark, sf_dir):
    """Path and digest of every file of a folder."""
    return layers.file_manifest(spark, files(spark, sf_dir), "/release-[0-9a-f]+/")


@query("zip_manifest")
def zip_manifest(spark, sf_dir):
    """Path and digest of every entry of archives: all pages, packed and written by tasks."""
    pages = table(spark, sf_dir, "pages").select(F.concat(F.coalesce(F.col("page_id").cast("string"), F.lit("null")), F.lit(".html")).alias("name"), F.col("html").alias("text"))
    return layers.zip_manifest(layers.write_layer(layers.zip_archives(pages, "plugin/"), folder(spark, "archives")), "plugin/")


@query("file_signature")
def file_signature(spark, sf_dir):
    """Size and time of each file: the key of what is cached from it."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(files(spark, sf_dir))
    return found.select("length", "modificationTime").where("length > 0")


@query("sink_json_report")
def sink_json_report(spark, sf_dir):
    path = folder(spark, "report")
    layers.json_report(weights(spark, sf_dir)[1], path)
    return spark.read.schema("key bigint, ok boolean, etag string, last_modified string, content_length bigint, made timestamp").json(path)
