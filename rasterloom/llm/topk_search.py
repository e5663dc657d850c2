"""Exact top-k inner-product search over an impact-ordered index.

A component's impact is the magnitude of its integer value, quantised to a power of two. The index lies
in files of blocks of vectors, longest vectors first. A block keeps posting segments from the
highest impact to the lowest: the segments of level p list, dimension by dimension, the vectors whose
component has its leading bit at p, with the values. Beside each level stands, for each vector, the norm of
what is left below it. A manifest row a block tells where each level lies and the block's greatest norm.

A task holds one block of queries and walks through the blocks of one group of the index, greatest norms
first. It carries each query's k-th score from block to block. A query skips a block whose norm cannot reach its
k-th score (Cauchy-Schwarz), and the walk ends when all queries do. Otherwise the block's levels are read one
by one: a level's products are added to the accumulators, and what the levels below can still add is bounded
by the norms left, so vectors that can reach no query's k-th score drop out. The scan of a block stops
only when that proves that few pairs are left, or after the last level; the possible members are then
rescored exactly from the block's rows, ties to the smaller id. Segments of levels that are not reached are not read.

Queries are a stated set and meet the index in blocks; only references to blocks and k rows a query and
group are shuffled, neither vectors nor segments.

Defined results: vectors that are null or hold a null, NaN or infinite component take no part, nor
do those with a null id, which is not another id than a query's (nor in the SQL); a shorter vector
has zeros beyond its end; a query's candidates are the rows with another id; rows that repeat an id
are candidates each. Scores must fit in 64 bits.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, only_memo, partitions, shared_path

#: Rows of an index block and of a query block, and most blocks of a group.
BLOCK, QUERY_BLOCK, GROUP = 4096, 1024, 4096
#: A block's scan stops once at most this share of its pairs is still possible.
ENOUGH = 0.01
PLACE = "struct<at:bigint,size:bigint>"
MANIFEST = f"file string, n int, width int, norm double, reach double, ids {PLACE}, rows {PLACE}, kind string, levels array<struct<level:int,at:bigint,size:bigint,postings:int,kind:string>>"
FOUND = "query_id bigint, vec_id bigint, score bigint"


def quantised(df: DataFrame, scale: float, id_col: str, vec_col: str) -> DataFrame:
    """id and v array<bigint>, floor(scale * x), of the rows that take part."""
    usable = F.col(vec_col).isNotNull() & F.forall(vec_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    return df.where(usable & F.col(id_col).cast("bigint").isNotNull()).select(F.col(id_col).cast("bigint").alias("id"), F.transform(vec_col, lambda x: F.floor(x.cast("double") * F.lit(float(scale)))).alias("v"))


def _matrix(column: pa.Array) -> np.ndarray:
    """The vectors of a batch as rows, zeros beyond the end of short ones."""
    rows = [np.asarray(x, "i8") for x in column.to_pylist()]
    out = np.zeros((len(rows), max((len(r) for r in rows), default=0)), "i8")
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


def _narrowest(m: np.ndarray) -> np.ndarray:
    """m in the narrowest whole numbers that hold it."""
    reach = int(np.abs(m).max(initial=0))
    return m.astype("<i1" if reach < 1 << 7 else "<i2" if reach < 1 << 15 else "<i4" if reach < 1 << 31 else "<i8")


def block_parts(ids: np.ndarray, m: np.ndarray) -> tuple[dict, list[bytes]]:
    """A block's manifest row, with places relative to its start, and its bytes."""
    parts: list[bytes] = []
    at = 0

    def put(*arrays: np.ndarray) -> dict:
        nonlocal at
        raw = b"".join(a.tobytes() for a in arrays)
        parts.append(raw)
        at += len(raw)
        return {"at": at - len(raw), "size": len(raw)}

    rows = _narrowest(m)
    told = {"ids": put(ids.astype("<i8")), "rows": put(rows), "kind": rows.dtype.str, "levels": [], "n": len(ids), "width": m.shape[1]}
    level = np.frexp(np.abs(m).astype("f8"))[1]  # bits of the magnitude; 0 for zero
    for p in sorted(set(level.ravel().tolist()) - {0}, reverse=True):
        d, i = np.nonzero((level == p).T)  # a segment is the run of one dimension
        left = np.where(level < p, m, 0).astype("f8")
        rest = np.nextafter(np.sqrt((left * left).sum(1)).astype("<f4"), np.float32(np.inf))
        ends, values = np.searchsorted(d, np.arange(1, m.shape[1] + 1)).astype("<u4"), _narrowest(m[i, d])
        told["levels"].append({"level": int(p), **put(np.where(rest < 1e-6, np.float32(0), rest).astype("<f4"), ends, i.astype("<u2"), values), "postings": len(d), "kind": values.dtype.str})
    told["norm"], told["reach"] = float(np.sqrt((m.astype("f8") ** 2).sum(1).max(initial=0))), float(np.abs(m).max(initial=0))
    return told, parts


def build_index(vectors: DataFrame, block: int, root: str | None = None) -> DataFrame:
    """Write blocks of at most `block` vectors, longest first in each task; returns the written manifest, one row a block."""
    folder = root or shared_path(vectors.sparkSession, "impact-index")

    def build(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        system, path = fs.FileSystem.from_uri(folder)
        system.create_dir(path)
        name = f"part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.imp"
        with system.open_output_stream(f"{path}/{name}", compression=None) as out:
            told = []
            for part in parts:
                for at in range(0, part.num_rows, block):
                    some = part.slice(at, block)
                    vecs = some.column(1)
                    sizes = np.diff(vecs.offsets.to_numpy())
                    m = np.zeros((some.num_rows, int(sizes.max(initial=0))), "i8")
                    m[np.arange(m.shape[1]) < sizes[:, None]] = vecs.flatten().to_numpy()
                    row, raw = block_parts(some.column(0).to_numpy(), m)
                    base = out.tell()
                    for place in (row["ids"], row["rows"], *row["levels"]):
                        place["at"] += base
                    out.write(b"".join(raw))
                    told.append({"file": f"{folder}/{name}", **row})
        # A file is closed before its blocks are told.
        if told:
            kinds = {"n": pa.int32(), "width": pa.int32(), "levels": pa.list_(pa.struct([("level", pa.int32()), ("at", pa.int64()), ("size", pa.int64()), ("postings", pa.int32()), ("kind", pa.string())]))}
            yield pa.RecordBatch.from_pydict({c: pa.array([t[c] for t in told], kinds.get(c)) for c in ("file", "n", "width", "norm", "reach", "ids", "rows", "kind", "levels")})

    length = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x)
    return materialise(vectors.sortWithinPartitions(length.desc()).mapInArrow(build, MANIFEST), "impact-manifest")


class Block:
    """A block of the index behind read(file, at, size); levels are read when they are asked for."""

    def __init__(self, told: dict, read: Callable[[str, int, int], bytes]):
        self.told, self.n, self.width = told, told["n"], told["width"]
        self.read = lambda place: read(told["file"], place["at"], place["size"])

    def ids(self) -> np.ndarray:
        return np.frombuffer(self.read(self.told["ids"]), "<i8")

    def rows(self) -> np.ndarray:
        return np.frombuffer(self.read(self.told["rows"]), self.told["kind"]).reshape(self.n, self.width)

    def level(self, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(norm that is left of each vector, dimension, place and value of each posting) of the k-th level."""
        told = self.told["levels"][k]
        raw = self.read(told)
        rest, ends = np.frombuffer(raw, "<f4", self.n), np.frombuffer(raw, "<u4", self.width, 4 * self.n)
        at = 4 * (self.n + self.width)
        places = np.frombuffer(raw, "<u2", told["postings"], at)
        values = np.frombuffer(raw, told["kind"], told["postings"], at + 2 * told["postings"])
        return rest, np.repeat(np.arange(self.width), np.diff(ends, prepend=np.uint32(0)).astype("i8")), places, values


class TopK:
    """The k best of each query so far; kth is each query's k-th score, or the lowest number while it has fewer."""

    def __init__(self, q_ids: np.ndarray, q: np.ndarray, k: int):
        self.q_ids, self.q, self.k = q_ids, q, k
        self.norm = np.sqrt((q.astype("f8") ** 2).sum(1))
        self.kth = np.full(len(q), -np.inf)
        self.row, self.id, self.score = (np.zeros(0, "i8") for _ in range(3))
        #: Blocks that no query needed, and levels that were read and that were left unread.
        self.skipped = self.read_levels = self.unread_levels = 0

    def take(self, row: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        row, ids, score = (np.concatenate(x) for x in ((self.row, row), (self.id, ids), (self.score, score)))
        order = np.lexsort((ids, -score, row))
        row, ids, score = row[order], ids[order], score[order]
        nth = np.arange(len(row)) - np.searchsorted(row, row)
        self.kth[row[nth == self.k - 1]] = score[nth == self.k - 1]
        self.row, self.id, self.score = row[nth < self.k], ids[nth < self.k], score[nth < self.k]

    def search(self, block: Block) -> bool:
        """Take the block's best; False if no query can find anything in it."""
        wide = max(block.width, self.q.shape[1])
        limit = self.norm * block.told["norm"] * (1 + 1e-9) + 1e-6
        asking = np.flatnonzero(limit >= self.kth)
        if not len(asking) or not block.n:
            self.skipped += 1
            return False
        q = np.zeros((len(asking), wide), "i8")
        q[:, : self.q.shape[1]] = self.q[asking]
        reach = float(np.abs(q).max(initial=0)) * block.told["reach"] * max(wide, 1)
        kind = "f4" if reach < 2**24 else "f8" if reach < 2**52 else "i8"  # products and sums are exact in each
        qf, kth, norm = q[:, : block.width].astype(kind), self.kth[asking][:, None], self.norm[asking][:, None] * (1 + 1e-6)
        ids, here = block.ids(), np.arange(block.n)
        score, possible = np.zeros((len(asking), block.n), kind), np.ones((len(asking), block.n), bool)
        levels = len(block.told["levels"])
        for k in range(levels):
            rest, dims, places, values = block.level(k)
            self.read_levels += 1
            tile = np.zeros((block.width, block.n), kind)
            tile[dims, places] = values
            score += qf @ (tile if len(here) == block.n else tile[:, here])
            possible = score >= kth - norm * rest[here][None, :] - 1e-3
            if k == levels - 1 or possible.mean() <= ENOUGH:
                self.unread_levels += levels - 1 - k
                break
            needed = possible.any(0)
            if needed.mean() < 0.5:  # go on with the vectors that some query may still take
                score, possible, here = np.ascontiguousarray(score[:, needed]), possible[:, needed], here[needed]
        own = self.q_ids[asking][:, None] == ids[here][None, :]
        possible &= ~own
        if len(here) > self.k and (open_ := np.flatnonzero(np.isinf(kth[:, 0]))).size:
            # A query without k scores has read all levels: its scores are exact, and only its k best and their ties can stay.
            exact = np.where(own[open_], -np.inf, score[open_].astype("f8"))
            possible[open_] &= exact >= np.partition(exact, -self.k, 1)[:, -self.k][:, None]
        row, col = np.nonzero(possible)
        rows = block.rows()
        found = [np.einsum("ij,ij->i", q[row[a : a + 65536], : block.width], rows[here[col[a : a + 65536]]].astype("i8")) for a in range(0, len(row), 65536)]
        self.take(asking[row], ids[here[col]], np.concatenate([*found, np.zeros(0, "i8")]).astype("i8"))
        return True


def top_k(df: DataFrame, k: int = 20, every: int = 20, scale: float = 64.0, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k best other rows for each row whose id is divisible by `every`."""
    spark = df.sparkSession
    vectors = quantised(df, scale, id_col, vec_col)
    index = build_index(vectors, BLOCK)
    queries = build_index(vectors.where(F.col("id") % every == 0), QUERY_BLOCK)
    blocks, asking = index.count(), max(queries.count(), 1)
    # As many groups as keep all tasks at work, and none of more blocks than GROUP.
    groups = max(1, min(blocks, max(-(-partitions(spark) // asking), -(-blocks // GROUP))))

    def search(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        only_memo("search")
        files: dict = {}

        def read(file: str, at: int, size: int) -> bytes:
            if file not in files:
                if len(files) >= 64:
                    files.pop(next(iter(files))).close()
                system, path = fs.FileSystem.from_uri(file)
                files[file] = system.open_input_file(path)
            return files[file].read_at(size, at)

        for part in parts:
            for told in part.to_pylist():
                asked = Block(told["query"], read)
                best = TopK(asked.ids(), asked.rows().astype("i8"), k)
                for block in sorted(told["blocks"], key=lambda b: -b["norm"]):
                    if not best.search(Block(block, read)):
                        break  # what follows has no longer vectors
                yield pa.RecordBatch.from_arrays([pa.array(best.q_ids[best.row]), pa.array(best.id), pa.array(best.score)], names=["query_id", "vec_id", "score"])

    whole = lambda d: F.struct(*d.columns)
    dealt = index.select(F.pmod(F.xxhash64("file", "ids.at"), F.lit(groups)).alias("group"), whole(index).alias("block"))
    grouped = dealt.groupBy("group").agg(F.collect_list("block").alias("blocks"))  # references, about GROUP at most
    asked = queries.select(whole(queries).alias("query"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(groups - 1).cast("bigint"))).alias("group"))
    met = asked.join(grouped, "group").repartition(partitions(spark), F.xxhash64("group", "query.file", "query.ids.at"))
    found = met.select("query", "blocks").mapInArrow(search, FOUND)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
