"""The tiled raster: round trips, an extent reads its tiles alone, and an aborted write leaves nothing to be seen."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from rasterloom.sources import tiled_raster as tr
from rasterloom.sources.layers import SAMPLES


def pixels(spark, images=2, high=50, wide=70):
    return spark.range(images * high * wide).select(F.expr(f"id div {high * wide}").alias("img_id"), F.expr(f"cast(id div {wide} % {high} as int)").alias("r"), (F.col("id") % wide).cast("int").alias("c"), ((F.col("id") * 37) % 201).cast("double").alias("v"))


def rows(df):
    return sorted(tuple(r) for r in df.select("img_id", "r", "c", "v").collect())


@pytest.mark.parametrize("held", sorted(SAMPLES))
def test_round_trip(spark, tmp_path, held):
    px = pixels(spark)
    tr.write_raster(px, str(tmp_path / "a"), held=held, tile=16)
    got = rows(tr.read_raster(spark, str(tmp_path / "a")).where("r < 50 and c < 70"))
    assert got == rows(px)
    assert tr.read_raster(spark, str(tmp_path / "a"), img_id=1).where("r < 50 and c < 70").count() == 3500


def test_places_without_a_pixel(spark, tmp_path):
    tr.write_raster(pixels(spark).where("(r + c) % 7 = 0"), str(tmp_path / "a"), tile=16)
    assert rows(tr.read_raster(spark, str(tmp_path / "a"))) == rows(pixels(spark).where("(r + c) % 7 = 0"))


def test_an_extent_reads_only_its_tiles(spark, tmp_path):
    path, place = str(tmp_path / "a"), (100.0, 400.0, 2.0, 5.0)
    tr.write_raster(pixels(spark), path, transform=place, tile=16)
    # Columns 20 to 33 are x 140 to 168, rows 10 to 20 are y 295 to 350.
    df = tr.read_raster(spark, path, extent=(140.0, 295.0, 168.0, 350.0), img_id=1)
    assert rows(df) == rows(pixels(spark).where("img_id = 1 and r between 10 and 20 and c between 20 and 33"))
    reader = tr.TileReader({"path": path, "img_id": "1", "xmin": "140", "ymin": "295", "xmax": "168", "ymax": "350"})
    assert {t[:3] for p in reader.partitions() for t in p.tiles} == {(1, i, j) for i in (0, 1) for j in (1, 2)}
    assert sum(len(p.tiles) for p in tr.TileReader({"path": path}).partitions()) == 2 * 4 * 5
    # What a plan reads are the partitions of those tiles, not of the raster.
    assert df.rdd.getNumPartitions() < tr.read_raster(spark, path).rdd.getNumPartitions()
    assert tr.read_raster(spark, path, extent=(0.0, 0.0, 1.0, 1.0)).count() == 0


def test_the_geometry_is_told_once_a_write(spark, tmp_path):
    path = str(tmp_path / "a")
    for image in (0, 1):
        tr.write_raster(pixels(spark).where(F.col("img_id") == image), path, held="u8", transform=(1.0, 2.0, 3.0, 4.0), tile=32)
    assert [(r["tile"], r["held"], r["transform"]) for r in tr.geometry_of(spark, path).collect()] == [(32, "u8", [1.0, 2.0, 3.0, 4.0])] * 2
    assert rows(tr.read_raster(spark, path).where("r < 50 and c < 70")) == rows(pixels(spark))


def test_an_aborted_write_shows_nothing(spark, tmp_path):
    path = str(tmp_path / "a")
    tr.write_raster(pixels(spark, images=1), path, tile=16)
    before = rows(tr.read_raster(spark, path))
    bad = pixels(spark).withColumn("v", F.when((F.col("img_id") == 1) & (F.col("r") == 40), F.raise_error(F.lit("broken row")).cast("double")).otherwise(F.col("v")))
    with pytest.raises(Exception, match="broken row"):
        tr.write_raster(bad, path, tile=16)
    assert rows(tr.read_raster(spark, path)) == before
    writer = tr.TileWriter({"path": path, "geometry": '{"tile": 1, "held": "f64", "transform": [0, 0, 1, 1]}'})
    import numpy as np
    import pyarrow as pa

    told = writer.write(iter([pa.RecordBatch.from_pydict({"img_id": [9], "i": [0], "j": [0], "data": [np.zeros(1).tobytes()]})]))
    assert (tmp_path / "a" / told.file).exists() and rows(tr.read_raster(spark, path)) == before
    writer.abort([told, None, tr.Written(None, {})])
    assert not list((tmp_path / "a").glob(f"{told.file}*"))


def test_no_pixels(spark, tmp_path):
    tr.write_raster(pixels(spark).where("false"), str(tmp_path / "a"))
    assert tr.read_raster(spark, str(tmp_path / "a")).count() == 0


def test_queries(spark):
    from rasterloom.plans.fixtures import mask
    from rasterloom.plans.storage import sink_edge_raster

    sf = "/root/testdata/sf0.001"
    got = sink_edge_raster(spark, sf).collect()
    assert {(r["img_id"], r["r"], r["c"]) for r in got} == {tuple(r) for r in mask(spark, sf).collect()}
    assert {(r["value"], tuple(r["transform"])) for r in got} == {(255, (0.0, 50.0, 1.0, 1.0))}
    assert not math.isnan(sum(r["value"] for r in got))
