"""Packing documents into as few fixed-size sequences as possible by bin completion.

How many sequences are needed depends on how many pieces there are of each length, and there are
at most `capacity` lengths. So one distributed count gives a histogram of bounded size, the driver
packs the histogram, and the packing comes out as patterns (so many pieces of these lengths) with
multiplicities. Pieces find their place by their rank among the pieces of their length: ranks are
counted inside (length, salt), so a length that a third of all pieces share is no hot group.

Packing: best fit over the histogram gives the incumbent; it is optimal if it meets the bound
that all lengths and the unfillable room beside long pieces give. Otherwise bin completion branches: around the largest piece left,
undominated fillings are enumerated lazily in order of waste, each is used as often as the counts allow and
then less often, and a branch is cut when its waste exceeds what a better packing may waste in all. The
search is complete but for its budget (TRIES): it ends at the bound or when nothing is left to try.

Defined results: a null text counts as empty and is its end id alone; repeated rows are packed
each; a document longer than the capacity is cut so that all its pieces but the first are full.
"""

from __future__ import annotations

import bisect
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bound_batches, give_back, materialise, partitions, text_of
from .tokenizing import batches, coder_for

DEFAULT_FILE, END_ID, CAPACITY = "byte_bpe_50k.json", 0, 2048
#: Fillings that the search may give up, as dominated or as leading to no better packing, before it keeps
#: the incumbent. The fillings of a descent are not counted: the first one always goes to its end.
TRIES = 20_000

#: A pattern is ((length, how many), ...) and is used in so many sequences.
Patterns = list[tuple[tuple[tuple[int, int], ...], int]]


def best_fit(counts: dict[int, int], capacity: int) -> Patterns:
    """Best fit decreasing; sequences with equal contents are one group, so work follows the lengths."""
    left: list[int] = []  # room in each group of open sequences, ascending
    open_: list[tuple[tuple, int]] = []
    full: Patterns = []

    def put(room: int, pattern: tuple, many: int) -> None:
        if not room:
            full.append((pattern, many))
            return
        at = bisect.bisect_left(left, room)
        left.insert(at, room)
        open_.insert(at, (pattern, many))

    for length in sorted(counts, reverse=True):
        todo = counts[length]
        while todo:
            at = bisect.bisect_left(left, length)
            if at < len(left):
                room, (pattern, many) = left.pop(at), open_.pop(at)
            else:
                room, pattern, many = capacity, (), todo
            each = room // length
            whole = min(many, todo // each)
            if whole:
                put(room - each * length, (*pattern, (length, each)), whole)
            todo -= whole * each
            many -= whole
            if many and 0 < todo < each:
                put(room - todo * length, (*pattern, (length, todo)), 1)
                many, todo = many - 1, 0
            if many and pattern:
                put(room, pattern, many)
    return full + open_


def fillings(rest: dict[int, int], lengths: list[int], capacity: int, most: int) -> Iterator[tuple[int, tuple[tuple[int, int], ...] | None]]:
    """(waste, filling) of the ways to fill a sequence around the largest piece left, in order of waste, then the longest pieces first.

    lengths are those that rest has, ascending; most is the greatest waste. A filling is dominated, and
    given as None, if a piece that is left fits beside it, or if a piece that is left can take the
    place of one or two of its pieces and still fits: the other filling is never worse. Only sums that
    the pieces left can make are followed, so each step leads to a filling.
    """
    room = capacity - lengths[-1]
    # A level of the search keeps these tables, and there may be thousands of levels, so they are small: counts by length,
    # no more of a length than a filling can hold and one, and by sum how many of the sizes, ascending, it takes to make it.
    kind, never = ("H", 0xFFFF) if room < 0xFFFE else ("L", 0xFFFFFFFF)
    counts = array(kind, [0]) * (room + 1)
    for x in lengths[: bisect.bisect_right(lengths, room)]:
        counts[x] = min(rest[x] - (x == lengths[-1]), room + 1)
    sizes = array(kind, (x for x, n in enumerate(counts) if n))
    every = (1 << room + 1) - 1
    made = np.full(room + 1, never, counts.typecode)
    made[0], sums = 0, 1
    for i, x in enumerate(sizes):
        if sums == every:
            break
        had, n, k = sums, min(counts[x], room // x), 1
        while n:
            k = min(k, n)
            sums |= sums << k * x & every
            n, k = n - k, 2 * k
        if sums != had:
            raw = np.frombuffer((sums ^ had).to_bytes(room // 8 + 1, "little"), "u1")
            made[np.flatnonzero(np.unpackbits(raw, bitorder="little")[: room + 1])] = i + 1
    least = array(kind, made.tobytes())

    def makes(i: int, total: int) -> bool:
        return least[total] <= i

    def exact(total: int, below: int) -> Iterator[tuple[tuple[int, int], ...]]:
        if not total:
            yield ()
            return
        i = min(below, bisect.bisect_right(sizes, total))
        while i and makes(i, total):
            i -= 1
            x = sizes[i]
            for k in range(min(counts[x], total // x), 0, -1):
                if makes(i, total - k * x):
                    for more in exact(total - k * x, i):
                        yield ((x, k), *more)

    def dominated(filling: tuple[tuple[int, int], ...], waste: int) -> bool:
        used = dict(filling)
        items = [x for x, k in filling for _ in range(min(k, 2))]
        for s in {0, *items, *(a + b for i, a in enumerate(items) for b in items[i + 1 :])}:
            for x in sizes[bisect.bisect_right(sizes, s) : bisect.bisect_right(sizes, s + waste)]:
                if counts[x] > used.get(x, 0):
                    return True
        return False

    short = at = 0  # what all pieces up to the waste come to: an undominated filling holds them
    for waste in range(min(room, most) + 1):
        if at < len(sizes) and sizes[at] == waste:
            short, at = short + waste * counts[waste], at + 1
        if short > room - waste:
            return
        if makes(len(sizes), room - waste):
            for filling in exact(room - waste, len(sizes)):
                yield waste, None if waste and dominated(filling, waste) else filling


def fewest_possible(counts: dict[int, int], capacity: int) -> int:
    """A lower bound: all lengths, and the room beside pieces over capacity - t that no piece up to t fills."""
    total, big = sum(x * n for x, n in counts.items()), sum(n for x, n in counts.items() if 2 * x > capacity)
    room = small = lost = 0
    for t in range(1, (capacity + 1) // 2):
        room += t * counts.get(capacity - t, 0)
        small += t * counts.get(t, 0)
        lost = max(lost, room - small)
    return max(-(-(total + lost) // capacity), big)


def bin_completion(counts: dict[int, int], capacity: int = CAPACITY, tries: int = TRIES) -> Patterns:
    """Patterns that hold counts[length] pieces of each length, in as few sequences as were found."""
    counts = {x: n for x, n in counts.items() if n}
    total = sum(x * n for x, n in counts.items())
    best = best_fit(counts, capacity)
    fewest = sum(m for _, m in best)
    bound = fewest_possible(counts, capacity)
    rest, lengths = dict(counts), sorted(counts)
    bins = waste = 0

    def use(pattern: dict[int, int], times: int) -> None:
        """Place the pattern so often; a negative number takes it back."""
        for x, k in pattern.items():
            had = rest[x]
            rest[x] -= k * times
            if not rest[x]:
                del lengths[bisect.bisect_left(lengths, x)]
            elif not had:
                bisect.insort(lengths, x)

    # Each level: its fillings, the one they start after, its waste, pattern, uses, and place in the order.
    stack: list[list] = []
    down = True
    while fewest > bound and tries > 0:
        # A packing that is better by one sequence may waste this much in all.
        spare = (fewest - 1) * capacity - total - waste
        if down and not lengths:
            best, fewest = [(tuple(sorted(p.items(), reverse=True)), m) for _, _, _, p, m, _ in stack], bins
            down, tries = False, tries - 1
            continue
        if down:
            # Sequences around equal largest pieces are made in the order of their fillings, so that none is made twice.
            after = stack[-1][5] if stack and lengths[-1] == max(stack[-1][3]) else ()
            stack.append([fillings(rest, lengths, capacity, spare), after, 0, {}, 0, ()])
            down = False
        level = stack[-1]
        found, after, w, pattern, times, _ = level
        if times:
            use(pattern, -times)
            bins, waste = bins - times, waste - w * times
            spare = (fewest - 1) * capacity - total - waste
            times = 0 if spare < 0 else min(times - 1, spare // w) if w else times - 1
        while not times and tries > 0:
            w, filling = next(found, (spare + 1, ()))
            if w > spare:
                break
            key = (w, tuple((-x, -k) for x, k in filling or ()))
            if filling is None or key <= after:
                tries -= 1
                continue
            pattern = dict(filling)
            pattern[lengths[-1]] = pattern.get(lengths[-1], 0) + 1
            times = min(rest[x] // k for x, k in pattern.items())
            times = min(times, spare // w) if w else times
            level[2], level[3], level[5] = w, pattern, key
        level[4] = times
        if times:
            use(pattern, times)
            bins, waste, down = bins + times, waste + w * times, True
            continue
        stack.pop()
        tries -= 1
        if not stack:
            break
    return best


def cut(df: DataFrame, name: str = DEFAULT_FILE, end_id: int = END_ID, capacity: int = CAPACITY, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, piece, start, length, ids_crc32 (and ids) of every piece of every document of df."""

    def pieces(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, end = coder_for(name), np.uint32(end_id).tobytes()
        for part in parts:
            ids, texts = part.column(0).to_pylist(), part.column(1).to_pylist()
            for a, b in batches(texts):
                rows = []
                for i, coded in zip(ids[a:b], coder.ids(texts[a:b])):
                    coded += end
                    n = len(coded) // 4
                    first = (n - 1) % capacity + 1
                    edges = [0, *range(first, n + 1, capacity)]
                    rows += [(i, k, s, e - s, zlib.crc32(coded[4 * s : 4 * e]), np.frombuffer(coded[4 * s : 4 * e], "<u4") if with_ids else None) for k, (s, e) in enumerate(zip(edges, edges[1:]))]
                cols = list(zip(*rows))
                out = [pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))]
                names = [id_col, "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    out.append(pa.array([x.astype("i4") for x in cols[5]], pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(out, names=names)
            give_back()

    bound_batches(df.sparkSession)
    narrow = df.select(F.col(id_col).cast("bigint").alias(id_col), text_of(text_col).alias("text"))
    return narrow.mapInArrow(pieces, f"{id_col} bigint, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids array<int>" * with_ids)


def place(pieces: DataFrame, capacity: int = CAPACITY, tries: int = TRIES, id_col: str = "doc_id") -> DataFrame:
    """pieces (written, so that its rows are fixed) with sequence_id and offset."""
    spark = pieces.sparkSession
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most capacity rows
    found: dict[int, list[tuple[int, int, int, int]]] = {}
    ranks: dict[int, int] = {}
    sequence = 0
    for pattern, times in bin_completion(counts, capacity, tries):
        at = 0
        for length, each in pattern:
            found.setdefault(length, []).append((ranks.get(length, 0), each, sequence, at))
            ranks[length] = ranks.get(length, 0) + each * times
            at += length * each
        sequence += times
    tables = {length: np.array(rows, "i8").T for length, rows in found.items()}  # a few rows a length

    def assign(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            length, rank = (part.column(part.schema.get_field_index(c)).to_numpy() for c in ("length", "rank"))
            order = np.argsort(length, kind="stable")
            sequence_id, offset = np.empty(len(length), "i8"), np.empty(len(length), "i8")
            edges = np.flatnonzero(np.diff(length[order])) + 1
            for rows in np.split(order, edges) if len(order) else []:
                first, each, base, at = tables[int(length[rows[0]])]
                k = np.searchsorted(first, rank[rows], "right") - 1
                nth = rank[rows] - first[k]
                sequence_id[rows] = base[k] + nth // each[k]
                offset[rows] = at[k] + nth % each[k] * length[rows]
            kept = [part.column(i) for i in range(part.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(sequence_id), pa.array(offset)], names=[*part.schema.names[:-1], "sequence_id", "offset"])

    salts = partitions(spark)
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64(id_col, "piece"), F.lit(salts)))
    here = Window.partitionBy("length", "salt")
    before = F.sum("n").over(Window.partitionBy("length").orderBy("salt")) - F.col("n")
    firsts = salted.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n")).withColumn("first", before).drop("n")
    ranked = salted.withColumn("nth", F.row_number().over(here.orderBy(id_col, "piece")) - 1).join(firsts, ["length", "salt"])
    out = ranked.select(*pieces.columns, (F.col("first") + F.col("nth")).alias("rank"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    return out.mapInArrow(assign, f"{schema}, sequence_id bigint, offset bigint")


def pack_documents(df: DataFrame, name: str = DEFAULT_FILE, end_id: int = END_ID, capacity: int = CAPACITY, tries: int = TRIES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, piece, start, length, ids_crc32, sequence_id, offset of every piece."""
    return place(materialise(cut(df, name, end_id, capacity, id_col=id_col, text_col=text_col), "pack-pieces"), capacity, tries, id_col)


def sequences(df: DataFrame, name: str = DEFAULT_FILE, end_id: int = END_ID, capacity: int = CAPACITY, tries: int = TRIES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The training rows: sequence_id and ids, the pieces of each sequence in place; a group is one sequence."""
    pieces = place(materialise(cut(df, name, end_id, capacity, True, id_col, text_col), "pack-ids"), capacity, tries, id_col)
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return pieces.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda p: p["ids"])).alias("ids"))
