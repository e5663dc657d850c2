"""The operators that are global in an image, on images of any size: no group is larger than a tile.

An image is cut into square tiles, each one row with its pixels packed. What reaches across tiles is exchanged:

* hysteresis: components of a tile are labelled by their first pixel; pixels on facing borders of two tiles give edges
  between labels, whose components say which labels hang on a strong pixel somewhere. Only borders and labels are shuffled.
* thinning: a tile with a halo of HALO pixels is right after HALO / 2 rounds, as a round looks two pixels far; then halos are
  exchanged anew, until a step changes no tile.
* distance: separable. Columns first, in strips of all rows and few columns; then rows, in strips of few rows and all
  columns, where the lower envelope of the columns' parabolas is exact. A strip has about as many pixels as a tile.

All give what the kernels of one view give (operators.kernels), to which the tests hold them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.layers import written_table
from . import components
from .kernels import labels_of, thin_round

#: Pixels of a tile along an axis, and of the halo that thinning exchanges.
TILE, HALO = 256, 16
#: A label is its first pixel, row * SHIFT + column.
SHIFT = 1 << 31
KEY = "img_id bigint, i int, j int"


def pack(px: DataFrame, value: str, size: int = TILE, fill: float = 0.0) -> DataFrame:
    """img_id, i, j, data: the values of each tile of px (img_id, r, c, value) as doubles; `fill` where no pixel is."""

    def go(key: tuple, group: pa.Table) -> pa.Table:
        img, i, j = (k.as_py() for k in key)
        a = np.full((size, size), fill)
        a[group.column("r").to_numpy() - i * size, group.column("c").to_numpy() - j * size] = group.column("v").to_numpy()
        return pa.table({"img_id": pa.array([img], pa.int64()), "i": pa.array([i], pa.int32()), "j": pa.array([j], pa.int32()), "data": pa.array([a.tobytes()], pa.binary())})

    at = lambda c: F.floor(F.col(c) / size).cast("int")
    parts = int(px.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = px.select("img_id", "r", "c", F.col(value).cast("double").alias("v"), at("r").alias("i"), at("c").alias("j")).repartition(parts, "img_id", "i", "j")
    # Dealt by a number, so that few small tiles, on each of which much work waits, do not become one task.
    return dealt.groupBy("img_id", "i", "j").applyInArrow(go, f"{KEY}, data binary")


def _rows(part: pa.RecordBatch):
    return zip(*(part.column(n).to_pylist() for n in part.schema.names))


def _batch(schema: dict[str, pa.DataType], rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(schema.values())], names=list(schema))


PIXELS = {"img_id": pa.int64(), "r": pa.int32(), "c": pa.int32()}


def _pixels(img: int, i: int, j: int, on: np.ndarray, size: int) -> pa.RecordBatch:
    r, c = np.nonzero(on)
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(r), img, "i8")), pa.array((r + i * size).astype("i4")), pa.array((c + j * size).astype("i4"))], names=list(PIXELS))


def _labels(data: bytes, i: int, j: int, low: float, size: int) -> tuple[np.ndarray, np.ndarray]:
    """A tile's values, and each pixel's label, -1 below low."""
    v = np.frombuffer(data).reshape(size, size)
    number = labels_of(v >= low)
    on = number > 0
    out = np.full(v.shape, -1, "i8")
    r, c = np.nonzero(on)
    first = np.full(int(number.max(initial=0)) + 1, np.iinfo("i8").max)
    np.minimum.at(first, number[on], (r + i * size).astype("i8") * SHIFT + c + j * size)
    out[on] = first[number[on]]
    return v, out


def hysteresis(px: DataFrame, value: str, low: float, high: float, size: int = TILE) -> DataFrame:
    """img_id, r, c: pixels of at least low that hang on one of at least high, over eight neighbours."""
    tiles = written_table(pack(px, value, size, fill=-np.inf), "tiles")
    border = {**PIXELS, "i": pa.int32(), "j": pa.int32(), "node": pa.int64(), "strong": pa.bool_()}

    def borders(parts):
        for part in parts:
            for img, i, j, data in _rows(part):
                v, label = _labels(data, i, j, low, size)
                strong = np.unique(label[v >= high])
                edge = np.zeros(v.shape, bool)
                edge[[0, -1]] = edge[:, [0, -1]] = True
                r, c = np.nonzero(edge & (label >= 0))
                node = label[r, c]
                yield _batch(border, list(zip([img] * len(r), (r + i * size).tolist(), (c + j * size).tolist(), [i] * len(r), [j] * len(r), node.tolist(), np.isin(node, strong).tolist())))

    met = written_table(tiles.mapInArrow(borders, "img_id bigint, r int, c int, i int, j int, node bigint, strong boolean"), "tile-borders")
    ahead = F.explode(F.array(*(F.struct(F.lit(a).alias("dr"), F.lit(b).alias("dc")) for a, b in ((0, 1), (1, -1), (1, 0), (1, 1))))).alias("o")
    sent = met.select("img_id", F.col("i").alias("of_i"), F.col("j").alias("of_j"), F.col("node").alias("u"), "r", "c", ahead).select("img_id", "of_i", "of_j", "u", (F.col("r") + F.col("o.dr")).alias("r"), (F.col("c") + F.col("o.dc")).alias("c"))
    edges = sent.join(met, ["img_id", "r", "c"]).where("of_i <> i or of_j <> j").select("img_id", "u", F.col("node").alias("v"))
    nodes = met.groupBy("img_id", "node").agg(F.max("strong").alias("strong"), F.first("i").alias("i"), F.first("j").alias("j"))
    joined = nodes.join(components.roots(edges), ["img_id", "node"], "left").withColumn("root", F.coalesce("root", "node"))
    held = joined.join(joined.where("strong").select("img_id", "root").distinct(), ["img_id", "root"]).groupBy("img_id", "i", "j").agg(F.collect_list("node").alias("kept"))  # at most a tile's border

    def keep(parts):
        for part in parts:
            for img, i, j, data, kept in _rows(part):
                v, label = _labels(data, i, j, low, size)
                stays = np.concatenate([np.unique(label[v >= high]), np.array(kept or [], "i8")])
                yield _pixels(img, i, j, (label >= 0) & np.isin(label, stays), size)

    return tiles.join(held, ["img_id", "i", "j"], "left").select("img_id", "i", "j", "data", "kept").mapInArrow(keep, "img_id bigint, r int, c int")


def thin(px: DataFrame, size: int = TILE, halo: int = HALO) -> DataFrame:
    """img_id, r, c: centre lines of the on-pixels px (img_id, r, c)."""
    kinds = {"img_id": pa.int64(), "i": pa.int32(), "j": pa.int32(), "di": pa.int32(), "dj": pa.int32(), "data": pa.binary()}

    def begin(parts):
        for part in parts:
            yield _batch({n: kinds[n] for n in ("img_id", "i", "j", "data")}, [(img, i, j, (np.frombuffer(data) > 0).tobytes()) for img, i, j, data in _rows(part)])

    def side(d: int) -> tuple[slice, slice]:
        """What a tile shows a neighbour in direction d, and where that puts it."""
        return {0: (slice(0, size), slice(halo, halo + size)), 1: (slice(size - halo, size), slice(0, halo)), -1: (slice(0, halo), slice(halo + size, size + 2 * halo))}[d]

    def show(parts):
        for part in parts:
            rows = []
            for img, i, j, data, *_ in _rows(part):
                on = np.frombuffer(data, bool).reshape(size, size)
                for di in (-1, 0, 1):
                    for dj in (-1, 0, 1):
                        seen = on[side(di)[0], side(dj)[0]]
                        if (di, dj) == (0, 0) or seen.any():
                            rows.append((img, i + di, j + dj, di, dj, seen.tobytes()))
            yield _batch(kinds, rows)

    def run(key: tuple, group: pa.Table) -> pa.Table:
        canvas, has = np.zeros((size + 2 * halo, size + 2 * halo), bool), False
        for di, dj, data in zip(*(group.column(n).to_pylist() for n in ("di", "dj", "data"))):
            there = canvas[side(di)[1], side(dj)[1]]
            there[:] = np.frombuffer(data, bool).reshape(there.shape)
            has |= (di, dj) == (0, 0)
        if not has:  # a tile without on-pixels gets none
            return pa.table({"img_id": pa.array([], pa.int64()), "i": pa.array([], pa.int32()), "j": pa.array([], pa.int32()), "data": pa.array([], pa.binary()), "changed": pa.array([], pa.bool_())})
        core = (slice(halo, halo + size),) * 2
        before = canvas[core].copy()
        for _ in range(halo // 2):
            after = thin_round(canvas)
            if (after == canvas).all():
                break
            canvas = after
        img, i, j = (k.as_py() for k in key)
        return pa.table({"img_id": pa.array([img], pa.int64()), "i": pa.array([i], pa.int32()), "j": pa.array([j], pa.int32()), "data": pa.array([canvas[core].tobytes()], pa.binary()), "changed": pa.array([bool((before != canvas[core]).any())])})

    tiles = pack(px.select("img_id", "r", "c").withColumn("on", F.lit(1)), "on", size).mapInArrow(begin, f"{KEY}, data binary")
    while True:
        shown = tiles.select("img_id", "i", "j", "data").mapInArrow(show, f"{KEY}, di int, dj int, data binary")
        tiles = written_table(shown.groupBy("img_id", "i", "j").applyInArrow(run, f"{KEY}, data binary, changed boolean"), "thinned")
        if tiles.where("changed").isEmpty():
            break

    def unpack(parts):
        for part in parts:
            for img, i, j, data in _rows(part):
                yield _pixels(img, i, j, np.frombuffer(data, bool).reshape(size, size), size)

    return tiles.select("img_id", "i", "j", "data").mapInArrow(unpack, "img_id bigint, r int, c int")


def envelope(square: np.ndarray) -> np.ndarray:
    """For each place the least over all places q of square[q] + (distance to q)**2; infinite ones don't count.

    Felzenszwalb and Huttenlocher (2012): the parabolas' lower envelope, one scan."""
    q = np.flatnonzero(np.isfinite(square))
    if not len(q):
        return np.full(len(square), np.inf)
    hull, from_ = [int(q[0])], [-np.inf]
    for p in q[1:].tolist():
        while True:
            k = hull[-1]
            at = (square[p] + p * p - square[k] - k * k) / (2 * (p - k))
            if at > from_[-1]:
                break
            hull.pop()
            from_.pop()
        hull.append(p)
        from_.append(at)
    x = np.arange(len(square))
    best = np.array(hull)[np.searchsorted(from_, x, "right") - 1]
    return square[best] + (x - best) ** 2


def distance(px: DataFrame, value: str, size: int = TILE, rows_away: int | None = None) -> DataFrame:
    """img_id, r, c, value: each pixel's exact distance to the nearest of px (img_id, r, c, value) that is not 0, in images
    without gaps; the image's diagonal where there is none. With rows_away, to the nearest of those at most so many rows
    away, and no row for a pixel without one."""
    shape = px.groupBy("img_id").agg((F.max("r") + 1).alias("high"), (F.max("c") + 1).alias("wide"))
    strip = lambda c, other: F.floor(F.col(c) / F.greatest(F.lit(1), F.floor(F.lit(size * size) / F.col(other)))).cast("int")
    whole = px.select("img_id", "r", "c", (F.col(value) != 0).alias("on")).join(shape, "img_id")

    def columns(group: pa.Table) -> pa.Table:
        r, c, on = (group.column(n).to_numpy() for n in ("r", "c", "on"))
        high, left = group.column("high")[0].as_py(), int(c.min())
        mask = np.zeros((high, int(c.max()) - left + 1), bool)
        mask[r, c - left] = on
        rows = np.arange(high)[:, None]
        above = np.maximum.accumulate(np.where(mask, rows, -np.inf), 0)
        below = np.minimum.accumulate(np.where(mask, rows, np.inf)[::-1], 0)[::-1]
        far = np.minimum(rows - above, below - rows)
        if rows_away is not None:
            far = np.where(far <= rows_away, far, np.inf)
        return pa.table({**{n: group.column(n) for n in ("img_id", "r", "c", "high", "wide")}, "far": pa.array(far[r, c - left])})

    def rows(group: pa.Table) -> pa.Table:
        r, c, far = (group.column(n).to_numpy() for n in ("r", "c", "far"))
        high, wide, top = group.column("high")[0].as_py(), group.column("wide")[0].as_py(), int(r.min())
        a = np.full((int(r.max()) - top + 1, wide), np.inf)
        a[r - top, c] = far
        best = np.stack([envelope(row) for row in a * a])
        if rows_away is None:
            best[~np.isfinite(best)] = high * high + wide * wide
        value = np.sqrt(best[r - top, c])
        told = pa.table({**{n: group.column(n) for n in ("img_id", "r", "c")}, "value": pa.array(value)})
        return told.filter(pa.array(np.isfinite(value)))

    down = whole.withColumn("strip", strip("c", "high")).groupBy("img_id", "strip").applyInArrow(columns, "img_id bigint, r int, c int, high int, wide int, far double")
    return down.withColumn("strip", strip("r", "wide")).groupBy("img_id", "strip").applyInArrow(rows, "img_id bigint, r int, c int, value double")
