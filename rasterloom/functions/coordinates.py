"""Coordinate and size expressions: between map units and pixels of a view."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def map_to_pixel(x: Column, y: Column, x_min: Column, y_max: Column, px_w: Column, px_h: Column) -> tuple[Column, Column]:
    """Pixel of a map point, truncated toward zero: points just outside the upper left land on pixel 0."""
    return ((x - x_min) / px_w).cast("int"), ((y_max - y) / px_h).cast("int")


def pixel_to_map(px: Column, py: Column, x_min: Column, y_max: Column, px_w: Column, px_h: Column) -> tuple[Column, Column]:
    """The upper left corner of a pixel in map units."""
    return x_min + px * px_w, y_max - py * px_h


def in_bounds(px: Column, py: Column, width: Column, height: Column) -> Column:
    return (px.cast("int") >= 0) & (px.cast("int") < width) & (py.cast("int") >= 0) & (py.cast("int") < height)


def clamp_pixel(p: Column, size: Column) -> Column:
    """The nearest pixel, halves to even, inside 0 .. size - 1."""
    return F.greatest(F.lit(0), F.least(size - 1, F.bround(p, 0).cast("int")))


def resampled_size(extent: Column, resolution: Column, least: int, most: int) -> Column:
    """Pixels along an axis at a resolution, halves to even, within caps; the least where there is no resolution."""
    wanted = F.bround(extent / resolution, 0).cast("int")
    return F.when(resolution > 0, F.greatest(F.lit(least), F.least(F.lit(most), wanted))).otherwise(F.lit(least))


def near(x1: Column, y1: Column, x2: Column, y2: Column, tolerance: Column) -> Column:
    return F.hypot(x1 - x2, y1 - y2) < tolerance


def snap_radius(weight: Column, most: int = 15) -> Column:
    """The edge-snap radius shrinks as the edge weight grows."""
    return F.greatest(F.lit(1), (F.lit(float(most)) * (F.lit(1.0) - F.lit(0.7) * weight)).cast("int"))


def wrap_angle(a: Column) -> Column:
    """An angle difference in [-pi, pi]."""
    pi = F.lit(3.141592653589793)
    return F.when(a > pi, a - 2 * pi).when(a < -pi, a + 2 * pi).otherwise(a)


def blend(x: Column, edge: Column, share: float = 0.3) -> Column:
    """A pointer drawn toward an edge."""
    return F.lit(1.0 - share) * x + F.lit(share) * edge
