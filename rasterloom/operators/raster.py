"""Raster operators on the pixel relation (img_id, r, c, value).

A neighbourhood is a list of offsets: every pixel sends its value to the pixels around it and the
values that meet are aggregated, with partial sums before the shuffle. Pixels are dealt by
(img_id, r, c), so neither a large image nor a popular one is a hot key, and no range join is planned.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PIXEL = ["img_id", "r", "c"]
Offsets = Sequence[tuple[int, int, int]]

#: Three-tap binomial kernel, and the 21-tap Gaussian of the adaptive threshold in 1/1024.
BINOMIAL = (1, 2, 1)
ADAPTIVE_SIZE = 21
ADAPTIVE_SIGMA = 0.3 * ((ADAPTIVE_SIZE - 1) * 0.5 - 1) + 0.8
ADAPTIVE = tuple(round(1024 * math.exp(-((i - ADAPTIVE_SIZE // 2) ** 2) / (2 * ADAPTIVE_SIGMA**2))) for i in range(ADAPTIVE_SIZE))
SOBEL_X = ((-1, -1, -1), (-1, 1, 1), (0, -1, -2), (0, 1, 2), (1, -1, -1), (1, 1, 1))
SOBEL_Y = tuple((dc, dr, w) for dr, dc, w in SOBEL_X)
EIGHT = tuple((dr, dc, 1) for dr in (-1, 0, 1) for dc in (-1, 0, 1) if dr or dc)


def finite(v: Column) -> Column:
    return v.isNotNull() & ~F.isnan(v) & (F.abs(v) != F.lit(float("inf")))


def fill_nonfinite(px: DataFrame) -> DataFrame:
    """Samples that are not finite become the least finite one of their view and band; 0 if there is none."""
    low = px.groupBy("img_id", "band").agg(F.min(F.when(finite(F.col("v")), F.col("v"))).alias("low"))
    return px.join(low, ["img_id", "band"]).withColumn("v", F.when(finite(F.col("v")), F.col("v")).otherwise(F.coalesce("low", F.lit(0.0)))).drop("low")


def normalize(px: DataFrame, as_bytes: Column | None = None) -> DataFrame:
    """u8: samples stretched from the least to the greatest finite one of each view and band to 0 .. 255, truncated; where as_bytes holds they are levels already."""
    good = F.when(finite(F.col("v")), F.col("v"))
    span = px.groupBy("img_id", "band").agg(F.min(good).alias("low"), F.max(good).alias("high"))
    v = F.when(finite(F.col("v")), F.col("v")).otherwise(F.col("low"))
    level = F.when(F.col("high") > F.col("low"), F.floor((v - F.col("low")) / (F.col("high") - F.col("low")) * F.lit(255.0)).cast("int")).otherwise(F.lit(0))
    if as_bytes is not None:
        level = F.when(as_bytes, F.col("v").cast("int")).otherwise(level)
    return px.join(span, ["img_id", "band"]).select(*px.columns, level.alias("u8"))


def extents(px: DataFrame) -> DataFrame:
    """img_id, height, width: one row an image."""
    return px.groupBy("img_id").agg((F.max("r") + 1).alias("height"), (F.max("c") + 1).alias("width"))


def send(px: DataFrame, offsets: Offsets) -> DataFrame:
    """Each pixel at every offset from it, with the offset's weight; positions may lie outside."""
    told = F.array(*(F.struct(F.lit(dr).alias("dr"), F.lit(dc).alias("dc"), F.lit(w).alias("weight")) for dr, dc, w in offsets))
    rest = [c for c in px.columns if c not in PIXEL]
    return px.select("*", F.explode(told).alias("__o")).select("img_id", (F.col("r") + F.col("__o.dr")).alias("r"), (F.col("c") + F.col("__o.dc")).alias("c"), *rest, F.col("__o.weight").alias("weight"))


def inside(px: DataFrame, extent: DataFrame) -> DataFrame:
    """The pixels that lie in their image; extent has one row an image."""
    return px.join(extent, "img_id").where("r >= 0 and c >= 0 and r < height and c < width").drop("height", "width")


def weighted_sums(px: DataFrame, offsets: Offsets, **values: Column) -> DataFrame:
    """For every pixel the weighted sums of values over its neighbourhood; neighbours outside are left out."""
    flipped = [(-dr, -dc, w) for dr, dc, w in offsets]
    sent = inside(send(px, flipped), extents(px))
    return sent.groupBy(*PIXEL).agg(*(F.sum(F.col("weight") * v).alias(n) for n, v in values.items()))


def blur(px: DataFrame, value: str = "g") -> DataFrame:
    """3 x 3 binomial blur with the weights renormalised at the border, rounded half up."""
    kernel = [(dr - 1, dc - 1, BINOMIAL[dr] * BINOMIAL[dc]) for dr in range(3) for dc in range(3)]
    sums = weighted_sums(px, kernel, s=F.col(value), w=F.lit(1))
    return sums.select(*PIXEL, F.expr("cast((2 * s + w) div (2 * w) as int)").alias(value))


def adaptive_threshold_inv(px: DataFrame, offset: int, value: str = "g") -> DataFrame:
    """on = 255 where a pixel is at least offset below its Gaussian mean over 21 x 21, in whole numbers."""
    half = ADAPTIVE_SIZE // 2
    across = weighted_sums(px, [(0, i - half, w) for i, w in enumerate(ADAPTIVE)], s=F.col(value).cast("bigint"), w=F.lit(1))
    both = weighted_sums(across, [(i - half, 0, w) for i, w in enumerate(ADAPTIVE)], s=F.col("s"), w=F.col("w"))
    return px.join(both, PIXEL).select(*PIXEL, F.when(F.col(value) * F.col("w") <= F.col("s") - F.lit(offset) * F.col("w"), 255).otherwise(0).alias("on"))


def sobel(px: DataFrame, value: str = "g") -> DataFrame:
    """gx, gy and the magnitude |gx| + |gy|; 0 on the border, where a neighbour is missing."""
    weights = {(dr, dc): [0, 0] for dr, dc, _ in EIGHT}
    for k, kernel in enumerate((SOBEL_X, SOBEL_Y)):
        for dr, dc, w in kernel:
            weights[dr, dc][k] = w
    code = [(dr, dc, (x + 2) * 10 + y + 2) for (dr, dc), (x, y) in weights.items()]
    flipped = [(-dr, -dc, w) for dr, dc, w in code]
    sent = inside(send(px, flipped), extents(px))
    gx, gy = F.expr("cast(weight div 10 as int) - 2"), F.expr("weight % 10 - 2")
    met = sent.groupBy(*PIXEL).agg(F.sum(gx * F.col(value)).alias("x"), F.sum(gy * F.col(value)).alias("y"), F.count(F.lit(1)).alias("n"))
    whole = lambda c: F.when(F.col("n") == 8, F.col(c)).otherwise(0).cast("int")
    return met.select(*PIXEL, whole("x").alias("gx"), whole("y").alias("gy")).withColumn("mag", F.abs("gx") + F.abs("gy"))


def thin_gradient(px: DataFrame) -> DataFrame:
    """mag, kept where no neighbour along the gradient's direction (in steps of 45 degrees) is larger, else 0."""
    ax, ay = F.abs("gx"), F.abs("gy")
    flat, steep = ay * 1000 <= ax * 414, ay * 414 >= ax * 1000
    dr = F.when(flat, 0).otherwise(1)
    dc = F.when(flat, 1).when(steep, 0).when(F.col("gx") * F.col("gy") > 0, 1).otherwise(-1)
    at = px.withColumns({"dr": dr, "dc": dc})
    for name, sign in (("before", -1), ("after", 1)):
        other = px.select("img_id", F.col("r").alias("nr"), F.col("c").alias("nc"), F.col("mag").alias(name))
        at = at.withColumns({"nr": F.col("r") + sign * F.col("dr"), "nc": F.col("c") + sign * F.col("dc")}).join(other, ["img_id", "nr", "nc"], "left").drop("nr", "nc")
    peak = (F.col("mag") > F.coalesce("before", F.lit(0))) & (F.col("mag") >= F.coalesce("after", F.lit(0)))
    return at.select(*PIXEL, F.when(peak, F.col("mag")).otherwise(0).alias("mag"))


def box(size: int) -> Offsets:
    """The offsets of a square element, anchored at its middle (lower right of the middle if even)."""
    a = size // 2
    return [(i - a, j - a, 1) for i in range(size) for j in range(size)]


def dilate(on: DataFrame, extent: DataFrame, size: int) -> DataFrame:
    """On-pixels (img_id, r, c) spread over the element."""
    return inside(send(on.select(*PIXEL), [(-dr, -dc, w) for dr, dc, w in box(size)]).drop("weight").distinct(), extent)


def erode(on: DataFrame, extent: DataFrame, size: int) -> DataFrame:
    """Pixels whose element lies on on-pixels; what lies outside the image is ignored."""
    a, b = size // 2, size - 1 - size // 2
    met = send(on.select(*PIXEL), [(-dr, -dc, w) for dr, dc, w in box(size)]).groupBy(*PIXEL).agg(F.count(F.lit(1)).alias("n")).join(extent, "img_id")
    span = lambda p, s: F.least(F.col(p) + b, F.col(s) - 1) - F.greatest(F.col(p) - a, F.lit(0)) + 1
    return met.where("r >= 0 and c >= 0 and r < height and c < width").where(F.col("n") == span("r", "height") * span("c", "width")).select(*PIXEL)


def close(on: DataFrame, extent: DataFrame, size: int) -> DataFrame:
    return erode(dilate(on, extent, size), extent, size)


def union_masks(*masks: DataFrame) -> DataFrame:
    out = masks[0].select(*PIXEL)
    for m in masks[1:]:
        out = out.unionByName(m.select(*PIXEL))
    return out.distinct()


def rasterize(segments: DataFrame, width: int = 2) -> DataFrame:
    """Pixels of segments (img_id, x1, y1, x2, y2, whole numbers), one step at a time along the longer axis, width pixels wide.

    A segment's pixels are made distinct in its row, as numbers; only those of images with several segments are compared."""
    row, half = 1 << 32, 1 << 31  # a pixel is r * row + c + half
    n = F.greatest(F.abs(F.col("x2") - F.col("x1")), F.abs(F.col("y2") - F.col("y1")))
    at = lambda a, b, i: F.when(n == 0, F.col(a)).otherwise(F.floor(F.col(a) + i * (F.col(b) - F.col(a)) / n + F.lit(0.5))).cast("bigint")
    line = F.transform(F.sequence(F.lit(0), n), lambda i: at("y1", "y2", i) * F.lit(row) + at("x1", "x2", i) + F.lit(half))
    brush = F.flatten(F.transform(line, lambda p: F.array(*(p + F.lit(i * row + j) for i in range(width) for j in range(width)))))
    counted = segments.withColumn("many", F.count(F.lit(1)).over(Window.partitionBy("img_id")) > 1)
    pixels = lambda some: some.select("img_id", F.explode(F.array_distinct(brush)).alias("p"))
    both = pixels(counted.where("not many")).unionByName(pixels(counted.where("many")).distinct())
    return both.select("img_id", F.shiftright("p", 32).cast("int").alias("r"), (F.col("p").bitwiseAND(F.lit(row - 1)) - F.lit(half)).cast("int").alias("c"))
