"""A raster in tiles as a Spark data source: an extent reads only the tiles that it meets, and a write shows whole or not at all.

A path holds data files of tiles one after another, beside each an index of its tiles (image, tile row and column, size and
offset), and a small file for each finished write, `commit-*.json`, which tells the geometry once (tile size, sample type, affine
transform) and lists the write's data files with the range of images and tiles in each. Tasks write data and index; only the
driver's commit, after all tasks have succeeded, makes them visible. An aborted write removes what it can and is never listed.

Reading plans from the commits: files whose ranges miss the extent are left out, the indexes of the others are read, and
the tiles that remain are dealt to partitions of PER_PARTITION tiles, each read by byte ranges.
"""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from ..operators import tiles
from .layers import SAMPLES

NAME = "tiled_raster"
PIXELS = "img_id bigint, r int, c int, v double"
PIXEL_TYPES = {"img_id": pa.int64(), "r": pa.int32(), "c": pa.int32(), "v": pa.float64()}
#: Tiles that a partition reads.
PER_PARTITION = 16
INDEX = np.dtype([("img", "<i8"), ("i", "<i4"), ("j", "<i4"), ("at", "<i8"), ("size", "<i8")])


def open_path(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


@dataclass
class Written(WriterCommitMessage):
    """A task's data file and the ranges of its tiles."""

    file: str | None
    ranges: dict


@dataclass
class Tiles(InputPartition):
    """Some tiles of one data file: (image, tile row, tile column, offset, bytes)."""

    file: str
    geometry: dict
    tiles: list[tuple[int, int, int, int, int]]


class TileReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.img = options["path"], options.get("img_id")
        self.extent = [float(options[k]) for k in ("xmin", "ymin", "xmax", "ymax")] if "xmin" in options else None

    def window(self, geometry: dict) -> tuple[int, int, int, int]:
        """First and last row and column of the pixels that the extent meets."""
        if self.extent is None:
            return 0, (1 << 31) - 1, 0, (1 << 31) - 1
        x_min, y_max, px_w, px_h = geometry["transform"]
        x0, y0, x1, y1 = self.extent
        return max(0, math.floor((y_max - y1) / px_h)), math.ceil((y_max - y0) / px_h) - 1, max(0, math.floor((x0 - x_min) / px_w)), math.ceil((x1 - x_min) / px_w) - 1

    def partitions(self) -> list[Tiles]:
        system, root = open_path(self.path)
        out = []
        for info in system.get_file_info(fs.FileSelector(root)):
            if not (info.base_name.startswith("commit-") and info.base_name.endswith(".json")):
                continue
            with system.open_input_file(info.path) as f:
                told = json.loads(f.read())
            size, (top, bottom, left, right) = told["geometry"]["tile"], self.window(told["geometry"])
            for file, ranges in told["files"].items():
                met = ranges["i"][0] <= bottom // size and ranges["i"][1] >= top // size and ranges["j"][0] <= right // size and ranges["j"][1] >= left // size
                if not met or self.img is not None and not ranges["img"][0] <= int(self.img) <= ranges["img"][1]:
                    continue
                with system.open_input_file(f"{root}/{file}.index") as f:
                    index = np.frombuffer(f.read(), INDEX)
                keep = (index["i"] >= top // size) & (index["i"] <= bottom // size) & (index["j"] >= left // size) & (index["j"] <= right // size)
                if self.img is not None:
                    keep &= index["img"] == int(self.img)
                chosen = [tuple(map(int, t)) for t in index[keep]]
                out += [Tiles(file, told["geometry"], chosen[k : k + PER_PARTITION]) for k in range(0, len(chosen), PER_PARTITION)]
        return out or [Tiles("", {}, [])]

    def read(self, partition: Tiles) -> Iterator[pa.RecordBatch]:
        if not partition.tiles:
            return
        system, root = open_path(self.path)
        size, held = partition.geometry["tile"], np.dtype(SAMPLES[partition.geometry["held"]])
        top, bottom, left, right = self.window(partition.geometry)
        with system.open_input_file(f"{root}/{partition.file}") as f:
            for img, i, j, at, length in partition.tiles:
                a = np.frombuffer(f.read_at(length, at), held).reshape(size, size).astype("f8")
                r, c = (x.ravel() + o * size for x, o in zip(np.indices(a.shape), (i, j)))
                keep = (r >= top) & (r <= bottom) & (c >= left) & (c <= right)
                if held.kind == "f":
                    keep &= ~np.isnan(a.ravel())  # no pixel there
                arrays = (np.full(int(keep.sum()), img, "i8"), r[keep].astype("i4"), c[keep].astype("i4"), a.ravel()[keep])
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(arrays, PIXEL_TYPES.values())], names=list(PIXEL_TYPES))


class TileWriter(DataSourceArrowWriter):
    """Writes rows (img_id, i, j, data), data being a tile's doubles."""

    def __init__(self, options: dict):
        self.path, self.geometry = options["path"], json.loads(options["geometry"])

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, root = open_path(self.path)
        system.create_dir(root, recursive=True)
        name, held, at, index = f"tiles-{uuid.uuid4().hex}", np.dtype(SAMPLES[self.geometry["held"]]), 0, []
        with system.open_output_stream(f"{root}/{name}", compression=None) as out:
            for part in iterator:
                for img, i, j, data in zip(*(part.column(c).to_pylist() for c in ("img_id", "i", "j", "data"))):
                    raw = np.frombuffer(data).astype(held).tobytes()
                    out.write(raw)
                    index.append((img, i, j, at, len(raw)))
                    at += len(raw)
        if not index:
            system.delete_file(f"{root}/{name}")
            return Written(None, {})
        table = np.array(index, INDEX)
        with system.open_output_stream(f"{root}/{name}.index", compression=None) as out:
            out.write(table.tobytes())
        return Written(name, {k: [int(table[k].min()), int(table[k].max())] for k in ("img", "i", "j")})

    def commit(self, messages: list[Written | None]) -> None:
        system, root = open_path(self.path)
        system.create_dir(root, recursive=True)
        name = f"{root}/commit-{uuid.uuid4().hex}.json"
        with system.open_output_stream(f"{name}.part", compression=None) as out:
            out.write(json.dumps({"geometry": self.geometry, "files": {m.file: m.ranges for m in messages if m and m.file}}).encode())
        system.move(f"{name}.part", name)

    def abort(self, messages: list[Written | None]) -> None:
        system, root = open_path(self.path)
        for m in messages:
            for file in (m.file, f"{m.file}.index") if m and m.file else ():
                system.delete_file(f"{root}/{file}")


class TiledRaster(DataSource):
    """format("tiled_raster"): reads pixels (img_id, r, c, v); options path, img_id, and xmin, ymin, xmax, ymax together."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return PIXELS

    def reader(self, schema) -> TileReader:
        return TileReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> TileWriter:
        if overwrite:
            raise ValueError("a tiled raster is only added to; write to a new path")
        return TileWriter(dict(self.options))


def write_raster(px: DataFrame, path: str, value: str = "v", held: str = "f32", transform: tuple[float, float, float, float] = (0.0, 0.0, 1.0, 1.0), tile: int = tiles.TILE) -> None:
    """Add the pixels px (img_id, r, c, value) to the raster at path. held: a sample type of SAMPLES; transform: x_min, y_max,
    pixel width and height. Places without a pixel are absent in float types and 0 in others."""
    spark = px.sparkSession
    spark.dataSource.register(TiledRaster)
    fill = math.nan if np.dtype(SAMPLES[held]).kind == "f" else 0.0
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = tiles.pack(px, value, tile, fill).repartitionByRange(parts, "img_id", "i", "j").sortWithinPartitions("img_id", "i", "j")
    geometry = {"tile": tile, "held": held, "transform": list(transform)}
    rows.write.format(NAME).mode("append").option("geometry", json.dumps(geometry)).save(path)


def read_raster(spark: SparkSession, path: str, extent: tuple[float, float, float, float] | None = None, img_id: int | None = None) -> DataFrame:
    """img_id, r, c, v: the pixels that extent (xmin, ymin, xmax, ymax in map units) meets, of one image or all."""
    spark.dataSource.register(TiledRaster)
    reader = spark.read.format(NAME)
    for k, v in zip(("xmin", "ymin", "xmax", "ymax"), extent or ()):
        reader = reader.option(k, repr(float(v)))
    return (reader if img_id is None else reader.option("img_id", str(img_id))).load(path)


def geometry_of(spark: SparkSession, path: str) -> DataFrame:
    """tile, held, transform: a row a write."""
    told = spark.read.schema("geometry struct<tile:int,held:string,transform:array<double>>").json(f"{path}/commit-*.json")
    return told.select("geometry.*").withColumn("file", F.input_file_name())
