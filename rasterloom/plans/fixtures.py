"""The supplied tables seen as rasters, lines, pointer events, manifests and model metadata.

Each adapter has a Spark form and the DuckDB text of the same relation, so both sides of a check
start from one definition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows of the supplied vectors that make one image, and its width.
IMAGE_ROWS, IMAGE_COLS = 50, 64

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


RASTER = """raster AS (
  SELECT (vec_id // 50)::BIGINT AS img_id, 1 AS band, (vec_id % 50)::INT AS r, c::INT AS c, embedding[c + 1]::DOUBLE AS v
  FROM embeddings, range(64) t(c))"""


def raster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """img_id, band, r, c, v: views of 50 by 64 pixels in one band."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(
        F.expr(f"vec_id div {IMAGE_ROWS}").alias("img_id"), F.lit(1).alias("band"), (F.col("vec_id") % IMAGE_ROWS).cast("int").alias("r"), F.posexplode("embedding").alias("c", "x")
    ).select("img_id", "band", "r", "c", F.col("x").cast("double").alias("v"))


RASTER3 = """raster3 AS (
  SELECT (vec_id // 50)::BIGINT AS img_id, (c % 3 + 1)::INT AS band, (vec_id % 50)::INT AS r, (c // 3)::INT AS c, embedding[c + 1]::DOUBLE AS v
  FROM embeddings, range(63) t(c))"""


def raster3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three interleaved bands of 50 by 21 pixels."""
    one = raster(spark, sf_dir).where(F.col("c") < 63)
    return one.select("img_id", (F.col("c") % 3 + 1).alias("band"), "r", F.expr("cast(c div 3 as int)").alias("c"), "v")


HOLED = """holed AS (
  SELECT img_id, band, r, c, CASE WHEN (r * 64 + c) % 97 = 0 THEN 'nan'::DOUBLE WHEN (r * 64 + c) % 101 = 0 THEN 'inf'::DOUBLE ELSE v END AS v FROM raster)"""


def holed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The raster with NaN and infinite samples."""
    at = F.col("r") * IMAGE_COLS + F.col("c")
    return raster(spark, sf_dir).withColumn("v", F.when(at % 97 == 0, F.lit(float("nan"))).when(at % 101 == 0, F.lit(float("inf"))).otherwise(F.col("v")))


GRAY = f"""{RASTER}, gray AS (
  SELECT img_id, r, c, floor((v - lo) / (hi - lo) * 255.0::DOUBLE)::INT AS g FROM (
    SELECT *, min(v) OVER (PARTITION BY img_id) AS lo, max(v) OVER (PARTITION BY img_id) AS hi FROM raster))"""


def gray(spark: SparkSession, sf_dir: str) -> DataFrame:
    """img_id, r, c, g: the raster as gray levels 0 .. 255."""
    from ..operators.raster import normalize

    return normalize(raster(spark, sf_dir)).select("img_id", "r", "c", F.col("u8").alias("g"))


#: All supplied vectors as one image, for the operators that work on tiles.
WHOLE = GRAY.replace("(vec_id // 50)::BIGINT AS img_id", "0::BIGINT AS img_id").replace("(vec_id % 50)::INT AS r", "vec_id::INT AS r")

MASK = f"{GRAY}, mask AS (SELECT img_id, r, c FROM gray WHERE g > 150)"


def mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """img_id, r, c: the pixels that are on."""
    return gray(spark, sf_dir).where("g > 150").select("img_id", "r", "c")


LINE_PTS = """line_pts AS (
  SELECT l_orderkey AS line_id, (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey))::INT AS seq,
         l_quantity AS x, l_extendedprice / 1000.0::DOUBLE AS y FROM lineitem)"""


def line_pts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """line_id, seq, x, y: the vertices of polylines, in order."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    return li.select(F.col("l_orderkey").alias("line_id"), F.row_number().over(order).alias("seq"), F.col("l_quantity").alias("x"), (F.col("l_extendedprice") / F.lit(1000.0)).alias("y"))


LINES = f"""{LINE_PTS}, lines AS (
  SELECT o_orderkey AS fid, o_orderkey::INT AS id, round(o_totalprice / 100, 1) AS elevation, pts FROM (
    SELECT line_id, list({{'x': x, 'y': y}} ORDER BY seq) AS pts FROM line_pts GROUP BY line_id) JOIN orders ON line_id = o_orderkey)"""


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """fid, id, elevation, geom: a line layer."""
    from ..operators.lines import make_polyline

    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("fid"), F.col("o_orderkey").cast("int").alias("id"), F.round(F.col("o_totalprice") / 100, 1).alias("elevation"))
    return o.join(make_polyline(line_pts(spark, sf_dir)).withColumnRenamed("line_id", "fid"), "fid")


EVENTS = """pointer AS (
  SELECT user_id AS session, ts, event_id, value AS x, (json_extract(props, '$.k'))::DOUBLE AS y,
         CASE event_type WHEN 'click' THEN 'press' WHEN 'view' THEN 'move' WHEN 'purchase' THEN 'drag' WHEN 'signup' THEN 'finish' ELSE 'undo' END AS kind,
         event_id % 3 = 0 AS manual FROM events)"""


def pointer_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """session, ts, event_id, x, y, kind, manual: pointer and key events in order (ts, event_id)."""
    return pointer_of(table(spark, sf_dir, "events"))


def pointer_of(e: DataFrame) -> DataFrame:
    kind = F.col("event_type")
    return e.select(
        F.col("user_id").alias("session"), F.col("ts").cast("timestamp").alias("ts"), "event_id", F.col("value").alias("x"), F.get_json_object("props", "$.k").cast("double").alias("y"),
        F.when(kind == "click", "press").when(kind == "view", "move").when(kind == "purchase", "drag").when(kind == "signup", "finish").otherwise("undo").alias("kind"), (F.col("event_id") % 3 == 0).alias("manual"),
    )


MANIFESTS = """expected AS (
  SELECT source || '/' || doc_id AS path, sha256(text) AS sha256 FROM documents
), actual AS (
  SELECT path, CASE WHEN doc_id % 13 = 0 THEN sha256('changed' || doc_id) ELSE sha END AS sha256
  FROM (SELECT doc_id, source || '/' || doc_id AS path, sha256(text) AS sha FROM documents) WHERE doc_id % 17 <> 0
  UNION ALL SELECT source || '/extra-' || doc_id, sha256(text) FROM documents WHERE doc_id % 19 = 0)"""


def manifests(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The expected and the actual manifest (path, sha256)."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.concat_ws("/", "source", "doc_id").alias("path"), F.sha2("text", 256).alias("sha256"), "source")
    changed = F.when(F.col("doc_id") % 13 == 0, F.sha2(F.concat(F.lit("changed"), F.col("doc_id")), 256)).otherwise(F.col("sha256"))
    extra = d.where("doc_id % 19 = 0").select(F.concat(F.col("source"), F.lit("/extra-"), F.col("doc_id")).alias("path"), "sha256")
    return d.select("path", "sha256"), d.where("doc_id % 17 <> 0").select("path", changed.alias("sha256")).unionByName(extra)


WEIGHTS = """weights_local AS (
  SELECT l.doc_id AS key, l.doc_id % 7 <> 0 AS present, CASE WHEN l.doc_id % 5 <> 0 THEN d.n_chars END AS size,
         CASE WHEN l.doc_id % 5 <> 1 THEN 'q' || l.quality END AS etag, CASE WHEN l.doc_id % 3 = 0 THEN 'day' || (l.doc_id % 4) END AS last_modified
  FROM labels l JOIN documents d ON l.doc_id = d.doc_id
), weights_remote AS (
  SELECT doc_id AS key, doc_id % 11 <> 0 AS ok, CASE WHEN doc_id % 4 <> 0 THEN 'q' || (doc_id % 2) END AS etag,
         CASE WHEN doc_id % 2 = 0 THEN 'day' || (doc_id % 4) END AS last_modified, CASE WHEN doc_id % 6 <> 0 THEN n_chars + (CASE WHEN doc_id % 10 = 1 THEN 1 ELSE 0 END) END AS content_length
  FROM documents)"""


def weights(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Local and remote metadata of model weights, with gaps of every kind."""
    d = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    i = F.col("doc_id")
    local = table(spark, sf_dir, "labels").join(d, "doc_id").select(
        i.alias("key"), (i % 7 != 0).alias("present"), F.when(i % 5 != 0, F.col("n_chars")).alias("size"), F.when(i % 5 != 1, F.concat(F.lit("q"), "quality")).alias("etag"), F.when(i % 3 == 0, F.concat(F.lit("day"), i % 4)).alias("last_modified")
    )
    remote = d.select(
        i.alias("key"), (i % 11 != 0).alias("ok"), F.when(i % 4 != 0, F.concat(F.lit("q"), i % 2)).alias("etag"), F.when(i % 2 == 0, F.concat(F.lit("day"), i % 4)).alias("last_modified"), F.when(i % 6 != 0, F.col("n_chars") + F.when(i % 10 == 1, 1).otherwise(0)).alias("content_length")
    )
    return local, remote


SPOTS = "spots AS (SELECT c_custkey AS fid, c_nationkey::DOUBLE AS x, (c_custkey % 100)::DOUBLE AS y, c_acctbal AS elevation FROM customer)"


def spots(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return c.select(F.col("c_custkey").alias("fid"), F.col("c_nationkey").cast("double").alias("x"), (F.col("c_custkey") % 100).cast("double").alias("y"), F.col("c_acctbal").alias("elevation"))


VIEWS = """views AS (
  SELECT o_orderkey AS view_id, (o_custkey % 50)::DOUBLE - 10.0::DOUBLE AS xmin, (o_custkey % 40)::DOUBLE - 5.0::DOUBLE AS ymin,
         (o_custkey % 50)::DOUBLE - 10.0::DOUBLE + o_totalprice / 5000.0::DOUBLE AS xmax, (o_custkey % 40)::DOUBLE - 5.0::DOUBLE + o_totalprice / 9000.0::DOUBLE AS ymax,
         0.0::DOUBLE AS rx0, 0.0::DOUBLE AS ry0, 64.0::DOUBLE AS rx1, 50.0::DOUBLE AS ry1, ((o_orderkey % 9) - 1)::DOUBLE / 10.0::DOUBLE AS resolution FROM orders)"""


def views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """view_id, the extent asked for, the raster's extent and a resolution (some not positive)."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    x0, y0 = (F.col("o_custkey") % 50).cast("double") - F.lit(10.0), (F.col("o_custkey") % 40).cast("double") - F.lit(5.0)
    return o.select(
        F.col("o_orderkey").alias("view_id"), x0.alias("xmin"), y0.alias("ymin"), (x0 + F.col("o_totalprice") / F.lit(5000.0)).alias("xmax"), (y0 + F.col("o_totalprice") / F.lit(9000.0)).alias("ymax"),
        F.lit(0.0).alias("rx0"), F.lit(0.0).alias("ry0"), F.lit(64.0).alias("rx1"), F.lit(50.0).alias("ry1"), ((F.col("o_orderkey") % 9 - 1).cast("double") / F.lit(10.0)).alias("resolution"),
    )


POINTS = f"""{LINE_PTS}, points AS (
  SELECT (line_id * 100 + seq)::BIGINT AS pid, x * 1.5::DOUBLE - 3.0::DOUBLE AS x, y / 1.5::DOUBLE - 1.0::DOUBLE AS y, line_id % 10 AS img_id FROM line_pts)"""


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pid, x, y, img_id: pointer positions over ten images, some outside."""
    return line_pts(spark, sf_dir).select(
        (F.col("line_id") * 100 + F.col("seq")).alias("pid"), (F.col("x") * F.lit(1.5) - F.lit(3.0)).alias("x"), (F.col("y") / F.lit(1.5) - F.lit(1.0)).alias("y"), (F.col("line_id") % 10).alias("img_id")
    )
