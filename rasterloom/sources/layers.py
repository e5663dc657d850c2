"""Sources and sinks: binary raster blocks, line and point layers, manifests of files and archives, reports."""

from __future__ import annotations

import hashlib
import io
import uuid
import warnings
import zipfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LINE_LAYER = "fid bigint, id int, elevation double, geom array<struct<x: double, y: double>>"
SPOT_LAYER = "fid bigint, x double, y double, elevation double"
#: NumPy types of raster samples.
SAMPLES = {"u8": "u1", "u16": "<u2", "i16": "<i2", "u32": "<u4", "i32": "<i4", "f32": "<f4", "f64": "<f8"}
#: An archive is closed at so many entries or so many bytes of text.
ARCHIVE_ENTRIES, ARCHIVE_BYTES = 500, 8_000_000


def decode_blocks(blocks: DataFrame) -> DataFrame:
    """img_id, r, c, v from raw blocks (img_id, width, height, held, data); a block of another length gives nothing."""

    def go(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for img, width, height, held, data in zip(*(c.to_pylist() for c in part.columns)):
                kind = np.dtype(SAMPLES[held]) if held in SAMPLES else None
                if kind is None or len(data) != width * height * kind.itemsize:
                    continue
                r, c = (x.ravel().astype("i4") for x in np.indices((height, width)))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(r), img)), pa.array(r), pa.array(c), pa.array(np.frombuffer(data, kind).astype("f8"))], names=["img_id", "r", "c", "v"])

    return blocks.select("img_id", "width", "height", "held", "data").mapInArrow(go, "img_id bigint, r int, c int, v double")


def memory_layer(spark: SparkSession, schema: str = LINE_LAYER) -> DataFrame:
    """An empty layer."""
    return spark.createDataFrame([], schema)


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share; one of its own only where all run on one machine."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = "/tmp/checkpoints"
    return root.rstrip("/")


def written_table(df: DataFrame, name: str) -> DataFrame:
    """df, written in the shared folder and read back: lineage ends there, and a lost executor costs only its tasks."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def get_or_create_layer(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The layer at path, made empty with the schema if there is none."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
    spark.createDataFrame([], schema).write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def append_to_layer(layer: DataFrame, rows: DataFrame, path: str) -> DataFrame:
    """The layer at path with rows added, in its columns."""
    rows.select(*layer.columns).write.mode("append").parquet(path)
    return layer.sparkSession.read.schema(layer.schema).parquet(path)


def write_layer(layer: DataFrame, path: str) -> DataFrame:
    """Write a layer as Parquet and read it back with its schema."""
    layer.write.mode("overwrite").parquet(path)
    return layer.sparkSession.read.schema(layer.schema).parquet(path)


def write_geojson(lines: DataFrame, path: str, crs: str) -> None:
    """One GeoJSON feature a line of text, as LineString in the reference system named."""
    geometry = F.struct(F.lit("LineString").alias("type"), F.transform("geom", lambda p: F.array(p["x"], p["y"])).alias("coordinates"))
    feature = F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), F.struct("id", "elevation", F.lit(crs).alias("crs")).alias("properties"))
    lines.select(F.to_json(feature).alias("value")).write.mode("overwrite").text(path)


def read_geojson(spark: SparkSession, path: str) -> DataFrame:
    """id, elevation, geom and crs of the features that write_geojson wrote."""
    point = "geometry struct<type: string, coordinates: array<array<double>>>, properties struct<id: int, elevation: double, crs: string>"
    told = spark.read.text(path).select(F.from_json("value", point).alias("f"))
    geom = F.transform("f.geometry.coordinates", lambda p: F.struct(p[0].alias("x"), p[1].alias("y")))
    return told.select("f.properties.id", "f.properties.elevation", geom.alias("geom"), "f.properties.crs")


def file_manifest(spark: SparkSession, path: str, root: str) -> DataFrame:
    """path below root and sha256 of every file of path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select(F.regexp_replace("path", "^.*" + root, "").alias("path"), F.sha2("content", 256).alias("sha256"))


def zip_archives(files: DataFrame, prefix: str) -> DataFrame:
    """content: zip archives of files (name, text), each below prefix; a null text is an empty entry, repeated names are kept each.

    A task closes an archive at ARCHIVE_ENTRIES entries or ARCHIVE_BYTES of text, so its memory is bounded by that and one text.
    """

    def go(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            held, size = [], 0
            for name, text in zip(*(part.column(i).to_pylist() for i in (0, 1))):
                held.append((name, (text or "").encode()))
                size += len(held[-1][1])
                if len(held) >= ARCHIVE_ENTRIES or size >= ARCHIVE_BYTES:
                    yield packed(held)
                    held, size = [], 0
            if held:
                yield packed(held)

    def packed(held: list[tuple[str, bytes]]) -> pa.RecordBatch:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z, warnings.catch_warnings():
            warnings.simplefilter("ignore")  # repeated names are told
            for name, data in held:
                z.writestr(zipfile.ZipInfo(prefix + name), data, zipfile.ZIP_DEFLATED)
        return pa.RecordBatch.from_arrays([pa.array([out.getvalue()], pa.binary())], names=["content"])

    return files.select("name", "text").mapInArrow(go, "content binary")


def zip_manifest(archives: DataFrame, prefix: str) -> DataFrame:
    """path and sha256 of the entries of zip archives (content), prefix taken off; an entry elsewhere fails the query."""

    def go(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for content in part.column(0).to_pylist():
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    entries = z.infolist()
                    for entry in entries:
                        if not entry.filename.startswith(prefix):
                            raise ValueError(f"{entry.filename} is not below {prefix}")
                    digests = [hashlib.sha256(z.read(entry)).hexdigest() for entry in entries]
                yield pa.RecordBatch.from_arrays([pa.array([e.filename.removeprefix(prefix) for e in entries], pa.string()), pa.array(digests, pa.string())], names=["path", "sha256"])

    return archives.select("content").mapInArrow(go, "path string, sha256 string")


def json_report(status: DataFrame, path: str) -> None:
    """One JSON record a row, with the time it was made."""
    status.withColumn("made", F.current_timestamp()).write.mode("overwrite").json(path)
