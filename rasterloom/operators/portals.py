"""Least costs between pixels of an image of any size, by blocks of tiles that are merged two by two.

A block knows the exact costs, inside it, between its portals: its pixels on borders to other blocks, and the asked pixels. Two
blocks are merged by the steps between them: only their pixels on the common border can stand in the middle of a chain, and
after that they are portals no more. Rounds so grow with the logarithm of the tiles. Blocks are merged while two have at most
MOST portals; what is left then is searched by a join a round: what has become cheaper goes along its edges, as long as it
is below the request's best total so far. A least-cost route is a chain of such costs, so they are those of a search of the
whole image.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.layers import written_table
from .kernels import STEPS
from .tiles import SHIFT, pack

#: Sources that are relaxed at once in a tile, and a difference of costs that is none.
LANES, SAME = 32, 1e-9
#: Portals of two blocks that are merged, and what a block is.
MOST = 1024
BLOCK = {"img_id": pa.int64(), "i": pa.int32(), "j": pa.int32(), "high": pa.int32(), "wide": pa.int32(), "n": pa.int32(), **dict.fromkeys(("node", "cost", "asked", "data"), pa.binary())}
BLOCK_ROW = "img_id bigint, i int, j int, high int, wide int, n int, node binary, cost binary, asked binary, data binary"
#: Rounds: a route that needs more tiles than this is an error.
MOST_ROUNDS = 100_000


def relaxed(cost: np.ndarray, sources: np.ndarray, backwards: bool = False) -> np.ndarray:
    """(sources, rows, columns): the costs from each source (row, column) to all pixels, or to it from all. A step costs its
    length times the cost of the pixel it enters; pixels of infinite cost are none."""
    d = np.full((len(sources), *cost.shape), np.inf)
    d[np.arange(len(sources)), sources[:, 0], sources[:, 1]] = 0.0
    high, wide = cost.shape
    while True:
        before = d.copy()
        for dr, dc, length in STEPS:
            to = (slice(None), slice(max(0, -dr), high - max(0, dr)), slice(max(0, -dc), wide - max(0, dc)))
            of = (slice(None), slice(max(0, dr), high - max(0, -dr)), slice(max(0, dc), wide - max(0, -dc)))
            step = length * (cost[of[1:]] if backwards else cost[to[1:]])
            d[to] = np.minimum(d[to], d[of] + step)  # at once in place, so that a round goes several steps far
        if not (d < before).any():
            return d


def facing(r: np.ndarray, c: np.ndarray, i: int, j: int, h: int, w: int, high: int, wide: int) -> np.ndarray:
    """Whether pixels of block (i, j), of h by w, lie on its border to another block of an image of high by wide."""
    return ((r == i * h) & (i > 0)) | ((r == (i + 1) * h - 1) & (r < high - 1)) | ((c == j * w) & (j > 0)) | ((c == (j + 1) * w - 1) & (c < wide - 1))


def _block(img: int, i: int, j: int, high: int, wide: int, node: np.ndarray, cost: np.ndarray, asked: np.ndarray, d: np.ndarray) -> dict:
    values = (img, i, j, high, wide, len(node), node.tobytes(), cost.tobytes(), asked.tobytes(), np.ascontiguousarray(d).tobytes())
    return {name: pa.array([v], kind) for (name, kind), v in zip(BLOCK.items(), values)}


def _first(size: int) -> Callable:
    """Tiles as blocks."""

    def go(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for q in part.to_pylist():
                cost = np.frombuffer(q["data"]).reshape(size, size)
                r, c = (x + k * size for x, k in zip(np.indices(cost.shape), (q["i"], q["j"])))
                asked = np.zeros(cost.shape, bool)
                for n in q["told"] or ():
                    asked[n // SHIFT - q["i"] * size, n % SHIFT - q["j"] * size] = True
                at = np.argwhere((asked | facing(r, c, q["i"], q["j"], size, size, q["high"], q["wide"])) & np.isfinite(cost))
                y, x = at[:, 0], at[:, 1]
                d = np.concatenate([np.zeros((0, len(at))), *(relaxed(cost, at[k : k + LANES])[:, y, x] for k in range(0, len(at), LANES))])
                yield pa.RecordBatch.from_pydict(_block(q["img_id"], q["i"], q["j"], q["high"], q["wide"], r[y, x].astype("i8") * SHIFT + c[y, x], cost[y, x], asked[y, x], d))

    return go


def _merge(h: int, w: int) -> Callable:
    """One block of h by w from those in it."""

    def go(key: tuple, group: pa.Table) -> pa.Table:
        img, i, j = (k.as_py() for k in key)
        rows = group.to_pylist()
        node, cost, asked = (np.concatenate([np.frombuffer(q[n], t) for q in rows]) for n, t in (("node", "i8"), ("cost", "f8"), ("asked", "?")))
        of = np.repeat(np.arange(len(rows)), [q["n"] for q in rows])
        d = np.full((len(node), len(node)), np.inf)
        for k, q in enumerate(rows):
            d[np.ix_(of == k, of == k)] = np.frombuffer(q["data"]).reshape(q["n"], q["n"])
        order = np.argsort(node)
        node, cost, asked, of, d = node[order], cost[order], asked[order], of[order], d[np.ix_(order, order)]
        seam = np.zeros(len(node), bool)
        for dr, dc, length in STEPS if len(node) else ():
            to = node + dr * SHIFT + dc
            k = np.minimum(np.searchsorted(node, to), len(node) - 1)
            u = np.flatnonzero((node[k] == to) & (of[k] != of))
            v = k[u]
            d[u, v] = length * cost[v]
            seam[u] = seam[v] = True
        for k in np.flatnonzero(seam):  # no other pixel is in the middle of a chain between the blocks
            np.minimum(d, d[:, k, None] + d[None, k], out=d)
        high, wide = rows[0]["high"], rows[0]["wide"]
        keep = asked | facing(node // SHIFT, node % SHIFT, i, j, h, w, high, wide)
        return pa.table(_block(img, i, j, high, wide, node[keep], cost[keep], asked[keep], d[np.ix_(keep, keep)]))

    return go


def _edges(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in parts:
        for q in part.to_pylist():
            node, d = np.frombuffer(q["node"], "i8"), np.frombuffer(q["data"]).reshape(q["n"], q["n"])
            u, v = np.nonzero(np.isfinite(d))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(u), q["img_id"], "i8")), pa.array(node[u]), pa.array(node[v]), pa.array(d[u, v])], names=["img_id", "u", "v", "w"])


def least_costs(costs: DataFrame, requests: DataFrame, size: int = 64, most: int = MOST) -> DataFrame:
    """req_id, total: the least cost from start to goal of requests (req_id, img_id, sr, sc, er, ec) over costs (img_id, r, c,
    cost), for those whose goal can be reached."""
    parts = int(costs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    node = lambda r, c: F.col(r).cast("bigint") * SHIFT + F.col(c)
    shape = costs.groupBy("img_id").agg((F.max("r") + 1).alias("high"), (F.max("c") + 1).alias("wide"))
    pixel = lambda r, c: F.struct(F.col(r).alias("r"), F.col(c).alias("c"))
    ends = requests.select("img_id", F.explode(F.array(pixel("sr", "sc"), pixel("er", "ec"))).alias("e")).select("img_id", "e.*")
    told = ends.groupBy("img_id", *(F.floor(F.col(c) / size).cast("int").alias(n) for c, n in (("r", "i"), ("c", "j")))).agg(F.collect_set(node("r", "c")).alias("told"))  # at most a tile's pixels
    tiles = pack(costs, "cost", size, fill=np.inf).join(shape, "img_id").join(told, ["img_id", "i", "j"], "left")
    blocks = written_table(tiles.repartition(parts, "img_id", "i", "j").mapInArrow(_first(size), BLOCK_ROW), "blocks")
    h = w = size
    while True:
        down, along = blocks.agg(F.max("i"), F.max("j")).first()
        if not down and not along:
            break
        by_rows = bool(down) and (h <= w or not along)
        half = F.floor(F.col("i" if by_rows else "j") / 2).cast("int")
        pairs = blocks.withColumn("i" if by_rows else "j", half)
        if pairs.groupBy("img_id", "i", "j").agg(F.sum("n").alias("n")).agg(F.max("n")).first()[0] > most:
            break
        h, w = (2 * h, w) if by_rows else (h, 2 * w)
        blocks = written_table(pairs.repartition(parts, "img_id", "i", "j").groupBy("img_id", "i", "j").applyInArrow(_merge(h, w), BLOCK_ROW), "blocks")

    edges = blocks.mapInArrow(_edges, "img_id bigint, u bigint, v bigint, w double")
    if down or along:
        border = costs.where((F.col("r") % h).isin(0, h - 1) | (F.col("c") % w).isin(0, w - 1)).select("img_id", "r", "c", "cost")
        ahead = F.explode(F.array(*(F.struct(F.lit(dr).alias("dr"), F.lit(dc).alias("dc"), F.lit(length).alias("length")) for dr, dc, length in STEPS))).alias("o")
        block = lambda r, c: F.struct(F.floor(F.col(r) / h), F.floor(F.col(c) / w))
        sent = border.select("img_id", F.col("r").alias("r0"), F.col("c").alias("c0"), ahead).select("img_id", "r0", "c0", "o.length", (F.col("r0") + F.col("o.dr")).alias("r"), (F.col("c0") + F.col("o.dc")).alias("c"))
        across = sent.where(block("r0", "c0") != block("r", "c")).join(border, ["img_id", "r", "c"]).select("img_id", node("r0", "c0").alias("u"), node("r", "c").alias("v"), (F.col("length") * F.col("cost")).alias("w"))
        edges = edges.unionByName(across)
    edges = written_table(edges.repartition("img_id", "u"), "portal-edges")
    totals = lambda d: d.where("node = goal_node").groupBy("req_id").agg(F.min("d").alias("total"))
    asked = requests.select("req_id", F.col("img_id").alias("of"), node("sr", "sc").alias("start"), node("er", "ec").alias("goal_node"))
    known = written_table(asked.join(edges, (F.col("of") == F.col("img_id")) & (F.col("start") == F.col("u"))).select("req_id", "img_id", "goal_node", F.col("v").alias("node"), F.col("w").alias("d")), "portal-costs")
    best, front = written_table(totals(known), "portal-totals"), known
    if not down and not along:
        return best
    for _ in range(MOST_ROUNDS):
        moved = front.join(edges, (front["img_id"] == edges["img_id"]) & (front["node"] == edges["u"])).select("req_id", front["img_id"], "goal_node", F.col("v").alias("node"), (F.col("d") + F.col("w")).alias("d"))
        moved = moved.groupBy("req_id", "img_id", "goal_node", "node").agg(F.min("d").alias("d"))
        seen = known.select("req_id", "node", F.col("d").alias("before"))
        cheaper = moved.join(seen, ["req_id", "node"], "left").join(best, "req_id", "left").where(f"(before is null or d < before - {SAME}) and (total is null or d < total)")
        front = written_table(cheaper.select(*known.columns), "portal-front")
        if front.isEmpty():
            return best
        known = written_table(known.unionByName(front).groupBy("req_id", "img_id", "goal_node", "node").agg(F.min("d").alias("d")), "portal-costs")
        best = written_table(best.unionByName(totals(front)).groupBy("req_id").agg(F.min("total").alias("total")), "portal-totals")
    raise RuntimeError("a route has more tiles than rounds")
