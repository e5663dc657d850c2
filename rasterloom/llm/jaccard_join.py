"""N-gram Jaccard join: a blocked sparse product of documents by n-grams, and its components.

1. Every text becomes its set of word n-grams as 64-bit hashes; texts with equal sets are one class.
   A sketch of fixed size counts all n-grams of the corpus by hash bucket.
2. Two sets that link share all but e of the n n-grams of either, e being what its size allows. So in
   the order (bucket count, hash) they share l of their first e + l n-grams, for every l. These
   prefixes are dealt into g = l - 1 groups by hash; two sets that link share two n-grams of one group,
   and each pair of n-grams in a group is a column. g is fixed for sizes within a factor of four, and
   a set that may have a partner beyond posts its columns there too. The sketch puts n-grams that
   very many texts share last, so they are hardly ever posted.
3. A column emits at most one row a document: in order of size and class, a document is chained to the one
   before it if their sizes are compatible. So the rows grow with the postings, whatever the size of a
   group of copies, and two sets that link are always in one cluster of chained sets.
4. A cluster is cut into blocks of bounded size, and a block's exact overlaps come from the product of
   its incidence matrix by its transpose: columns with the same documents are one weighted column,
   columns of few documents add to their pairs alone, the others are multiplied tile by tile. Pairs below
   the bound of their sizes are discarded, and of the links only stars of what they join leave the block. A
   cluster of several blocks compares every block with itself and the first; then what is not in the
   cluster's largest component so far is compared with all blocks. Pairs inside one component need
   no test, so no link that matters to a component is lost.

Defined results: a null text counts as empty; an empty set links with nothing and is its own
component; a text of fewer words than n has its whole word sequence as its one n-gram; repeated
rows and equal texts are in one component; a component's id is its smallest id, null if it has none.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, only_memo, partitions, text_of
from .components import components, nodes_of
from .word_hash import hash_words, mix

#: Buckets of the sketch and the slices in which it is added up.
BUCKET_BITS, SLICES = 18, 64
#: Documents and n-grams of a block; columns of up to FEW documents add to pairs alone; columns of a tile.
BLOCK_DOCS, BLOCK_GRAMS, FEW, TILE_COLUMNS = 512, 1_000_000, 24, 1024
#: Pairs of a product, and chained pairs of a task, that are held before they are added up.
HELD_PAIRS = 1 << 21
#: Texts hashed at once.
SLICE_DOCS = 1000


def gram_sets(column: pa.Array, words: int) -> Iterator[np.ndarray]:
    """The sorted distinct n-gram hashes of each text."""
    for at in range(0, len(column), SLICE_DOCS):
        h, counts = hash_words(column.slice(at, SLICE_DOCS))
        edges = np.concatenate([[0], np.cumsum(counts)])
        grams = np.zeros(max(len(h) - words + 1, 0), "u8")
        for k in range(words):
            grams = mix(grams * np.uint64(3) + h[k : k + len(grams)])
        for a, b in zip(edges, edges[1:]):
            if b - a >= words:
                yield np.unique(grams[a : b - words + 1])
            elif b > a:
                whole = np.array([1000 + b - a], "u8")
                for w in h[a:b]:
                    whole = mix(whole * np.uint64(3) + w)
                yield whole
            else:
                yield np.zeros(0, "u8")


def class_of(grams: np.ndarray) -> int:
    """A 64-bit number of the set."""
    if not len(grams):
        return 0
    mixed = mix(grams)
    both = np.bitwise_xor.reduce(mixed, keepdims=True) * np.uint64(7) + np.add.reduce(mixed, keepdims=True)
    return int(mix(both).view("i8")[0])


def least_overlap(n, percent: int):
    """What a set of n shares with any partner, at least."""
    return -(-percent * n // 100)


def level_of(n: int) -> int:
    """Sizes within a factor of four are on one level."""
    return (n.bit_length() - 1) // 2


def groups_of(level: int, percent: int) -> int:
    """Groups of a level: as many as a middling size may lose n-grams, which makes the fewest columns; 0 means
    that some set of the level may share less than two n-grams, so that single n-grams are the columns."""
    middle = 2 * 4**level
    groups = max(1, middle - least_overlap(middle, percent))
    for n in range(max(1, least_overlap(4**level, percent)), 4 ** (level + 1)):
        if least_overlap(n, percent) > groups:
            break
        if least_overlap(n, percent) < n or 100 * n // percent > n:
            return 0
    return groups


def survey(docs: DataFrame, words: int) -> DataFrame:
    """A written table: rows (id, sign, n, class) of all documents and, per task, its part of the sketch; sign is a hash of the text."""

    def go(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only_memo("n-grams")
        sketch = np.zeros(1 << BUCKET_BITS, "i8")
        names = ["id", "sign", "n", "class", "task", "slice", "counts"]
        empty = lambda k, t: pa.nulls(k, t)
        for part in parts:
            n, cls, waiting = [], [], []
            for g in gram_sets(part.column(1), words):
                n.append(len(g))
                cls.append(class_of(g))
                waiting.append((g >> np.uint64(64 - BUCKET_BITS)).astype("i4"))
                if len(waiting) >= SLICE_DOCS:
                    sketch += np.bincount(np.concatenate(waiting), minlength=len(sketch))
                    waiting = []
            if waiting:
                sketch += np.bincount(np.concatenate(waiting), minlength=len(sketch))
            k = part.num_rows
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(n, pa.int64()), pa.array(cls, pa.int64()), empty(k, pa.int64()), empty(k, pa.int32()), empty(k, pa.binary())], names=names)
        task = TaskContext.get().partitionId()
        slices = [zlib.compress(s.astype("<i8").tobytes(), 1) for s in np.split(sketch, SLICES)]
        yield pa.RecordBatch.from_arrays([*(empty(SLICES, pa.int64()) for _ in range(4)), pa.array(np.full(SLICES, task)), pa.array(np.arange(SLICES, dtype="i4")), pa.array(slices, pa.binary())], names=names)

    return materialise(docs.mapInArrow(go, "id bigint, sign bigint, n bigint, class bigint, task bigint, slice int, counts binary"), "gram-survey")


def sketch_of(surveyed: DataFrame) -> np.ndarray:
    """The whole sketch, 2**BUCKET_BITS counts: added up in groups of bounded size, in two steps."""

    def add(group: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(zlib.decompress(c), "<i8") for c in group.column("counts").to_pylist())
        return pa.table({"slice": group.column("slice").slice(0, 1), "counts": pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())})

    once = surveyed.where(F.col("slice").isNotNull()).withColumn("some", F.floor(F.col("task") / 512)).groupby("slice", "some").applyInArrow(add, "slice int, counts binary")
    rows = {r["slice"]: r["counts"] for r in once.groupby("slice").applyInArrow(add, "slice int, counts binary").collect()}  # SLICES rows
    return np.concatenate([np.frombuffer(zlib.decompress(rows[s]), "<i8") for s in range(SLICES)]) if rows else np.zeros(1 << BUCKET_BITS, "i8")


def columns_of(grams: np.ndarray, edges: np.ndarray, groups: int, salt: int) -> tuple[np.ndarray, np.ndarray]:
    """(number of the set, column) of the pairs of n-grams that lie in one group of a set; edges are the sets' edges in grams."""
    owner = np.repeat(np.arange(len(edges) - 1), np.diff(edges))
    salted = mix(grams + np.uint64(2 * salt + 1))
    if not groups:
        return owner, salted
    group = owner * groups + (salted % np.uint64(groups)).astype("i8")
    order = np.lexsort((salted, group))
    owner, group, salted = owner[order], group[order], salted[order]
    owners, columns = [], []
    for apart in range(1, len(group)):
        same = group[apart:] == group[:-apart]
        if not same.any():
            break
        owners.append(owner[apart:][same])
        columns.append(mix(salted[:-apart][same] * np.uint64(3) + salted[apart:][same]))
    return np.concatenate([*owners, np.zeros(0, "i8")]).astype("i8"), np.concatenate([*columns, np.zeros(0, "u8")]).astype("u8")


def postings(docs: DataFrame, sketch: np.ndarray, words: int, percent: int) -> DataFrame:
    """(gram, n, class): the columns of each class, at least once."""
    shipped = docs.sparkSession.sparkContext.broadcast(sketch)  # 2**BUCKET_BITS numbers at any size

    def go(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only_memo("n-grams")
        counts, seen = shipped.value, set()
        groups: dict[int, int] = {}
        waiting: dict[int, list[tuple[np.ndarray, int, int]]] = {}

        def close(level: int) -> pa.RecordBatch:
            sets = waiting.pop(level)
            owner, column = columns_of(np.concatenate([s for s, _, _ in sets]), np.cumsum([0, *(len(s) for s, _, _ in sets)]), groups[level], level)
            n, c = (np.array([s[k] for s in sets])[owner] for k in (1, 2))
            return pa.RecordBatch.from_arrays([pa.array(column.view("i8")), pa.array(n), pa.array(c)], names=["gram", "n", "class"])

        for part in parts:
            for g in gram_sets(part.column(1), words):
                n, c = len(g), class_of(g)
                larger = 100 * n // percent  # the largest partner
                if not n or c in seen or (larger == n and least_overlap(n, percent) == n):
                    continue
                seen.add(c)
                order = np.lexsort((g, counts[(g >> np.uint64(64 - BUCKET_BITS)).astype("i8")]))
                for level in {level_of(n), level_of(larger)}:
                    if level not in groups:
                        groups[level] = groups_of(level, percent)
                    waiting.setdefault(level, []).append((g[order[: n - least_overlap(n, percent) + groups[level] + 1]], n, c))
                    if len(waiting[level]) >= SLICE_DOCS:
                        yield close(level)
        for level in list(waiting):
            yield close(level)

    return docs.mapInArrow(go, "gram bigint, n bigint, class bigint")


def candidate_edges(posted: DataFrame, percent: int) -> DataFrame:
    """(u, v): stars that join neighbours of compatible sizes in each column; at most one row a document and task."""

    def go(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only_memo("n-grams")
        held = [np.zeros(0, "i8")] * 3  # the last posting of the batch before
        parent: dict[int, int] = {}
        pairs: list[np.ndarray] = []
        room = 0

        def find(x: int) -> int:
            while (up := parent.setdefault(x, x)) != x:
                parent[x] = x = parent[up]
            return x

        def join() -> None:
            nonlocal pairs, room
            p = np.concatenate(pairs) if pairs else np.zeros((0, 2), "i8")
            p = p[np.lexsort((p[:, 1], p[:, 0]))]
            for u, v in p[np.concatenate([[True], (p[1:] != p[:-1]).any(1)])[: len(p)]].tolist():
                a, b = find(u), find(v)
                parent[max(a, b)] = min(a, b)
            pairs, room = [], 0

        for part in parts:
            gram, n, c = (np.concatenate([h, x.to_numpy()]) for h, x in zip(held, part.columns))
            next_ = np.flatnonzero((gram[1:] == gram[:-1]) & (c[1:] != c[:-1]) & (100 * n[:-1] >= percent * n[1:])) + 1
            pairs.append(np.stack([c[next_], c[next_ - 1]], 1))
            room += len(next_)
            held = [x[-1:] for x in (gram, n, c)]
            if room > HELD_PAIRS:
                join()
        join()
        stars = np.array([(x, r) for x in list(parent) if (r := find(x)) != x], "i8").reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([pa.array(stars[:, 0].copy()), pa.array(stars[:, 1].copy())], names=["u", "v"])

    dealt = posted.repartition(partitions(posted.sparkSession), "gram").sortWithinPartitions("gram", "n", "class")
    return dealt.mapInArrow(go, "u bigint, v bigint")


def overlaps(grams: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The overlap of each two sets, above the diagonal; grams holds the sets one after the other, n their sizes."""
    docs = len(n)
    row = np.repeat(np.arange(docs, dtype="i4"), n)
    order = np.argsort(grams, kind="stable")
    grams, row = grams[order], row[order]
    starts = np.flatnonzero(np.concatenate([[True], grams[1:] != grams[:-1]])[: len(grams)])
    size = np.diff(np.append(starts, len(grams)))
    out = np.zeros(docs * docs, "i4")
    if not len(starts):
        return out.reshape(docs, docs)
    # Columns of the same documents are one column with a weight.
    owners = np.add.reduceat(mix(row.astype("u8") + np.uint64(1)), starts)
    _, first, weight = np.unique(owners, return_index=True, return_counts=True)
    kept = size[first] > 1
    starts, size, weight = starts[first[kept]], size[first[kept]], weight[kept]
    for m in np.unique(size[size <= FEW]):
        a, b = np.triu_indices(m, 1)
        here = np.flatnonzero(size == m)
        step = max(1, HELD_PAIRS // len(a))
        for at in range(0, len(here), step):
            some = here[at : at + step]
            members = row[starts[some][:, None] + np.arange(m)].astype("i8")  # ascending, as the sort is stable
            key = (members[:, a] * docs + members[:, b]).ravel()
            found, place = np.unique(key, return_inverse=True)
            out[found] += np.bincount(place, np.repeat(weight[some], len(a))).astype("i4")
    out = out.reshape(docs, docs)
    many = np.flatnonzero(size > FEW)
    for at in range(0, len(many), TILE_COLUMNS):
        some = many[at : at + TILE_COLUMNS]
        tile = np.zeros((docs, len(some)), "f4")
        column = np.repeat(np.arange(len(some)), size[some])
        within = np.arange(len(column)) - np.repeat(np.cumsum(size[some]) - size[some], size[some])
        tile[row[starts[some][column] + within], column] = 1
        product = (tile * weight[some].astype("f4")) @ tile.T  # whole numbers below 2**24
        out += np.triu(product, 1).astype("i4")
    return out


def block_links(grams: np.ndarray, n: np.ndarray, classes: np.ndarray, percent: int, known: np.ndarray) -> list[tuple[int, int]]:
    """Stars that join what the links between the sets of a block join; sets of one known component count as joined,
    and one of them stands for all."""
    n = np.asarray(n, "i8")
    linked = overlaps(grams, n)
    for i in range(len(n)):
        linked[i] = (100 + percent) * linked[i].astype("i8") >= percent * (n[i] + n)
    linked = np.triu(linked, 1).astype(bool)
    linked |= linked.T
    _, first, known = np.unique(known, return_index=True, return_inverse=True)
    seen, stars = np.zeros(len(first), bool), []
    for start in range(len(first)):
        joined, waiting = [], [] if seen[start] else [start]
        seen[start] = True
        while waiting:
            joined.append(k := waiting.pop())
            for i in np.flatnonzero(known == k):
                new = np.unique(known[linked[i] & ~seen[known]])
                seen[new] = True
                waiting += new.tolist()
        ends = sorted(int(classes[first[k]]) for k in joined)
        stars += [(e, ends[0]) for e in ends[1:]]
    return stars


def link_blocks(members: DataFrame, percent: int) -> DataFrame:
    """(u, v): stars of the links in each (cluster, block) of members, over classes; rows with equal known are joined."""

    def go(group: pa.Table) -> pa.Table:
        classes, at = np.unique(group.column("class").to_numpy(), return_index=True)
        known = group.column("known").to_numpy()[at]
        sets = group.column("grams")
        grams = [np.frombuffer(sets[int(i)].as_py(), "<u8") for i in at]
        n = np.array([len(g) for g in grams], "i8")
        grams = np.concatenate([*grams, np.zeros(0, "u8")])
        stars = block_links(grams, n, classes, percent, known)
        return pa.table({"u": pa.array([x[0] for x in stars], pa.int64()), "v": pa.array([x[1] for x in stars], pa.int64())})

    return members.select("cluster", "block", "class", "known", "grams").groupby("cluster", "block").applyInArrow(go, "u bigint, v bigint")


def linked_classes(docs: DataFrame, surveyed: DataFrame, clusters: DataFrame, words: int, percent: int) -> DataFrame:
    """(node, component) of the classes that have links."""

    def cut(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # a class once, though its first row may be repeated
        for part in parts:
            rows = []
            for g, c, b, k in zip(gram_sets(part.column(1), words), *(part.column(i).to_pylist() for i in (2, 3, 4))):
                if k not in seen and class_of(g) == k:
                    seen.add(k)
                    rows.append((c, b, k, g.tobytes()))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=["cluster", "blocks", "class", "grams"])

    first_row = F.min_by("sign", F.coalesce("id", F.lit(2**63 - 1))).alias("first_sign")
    classes = surveyed.where("n > 0").groupBy("class").agg(F.min("id").alias("first_id"), first_row, F.first("n").alias("n"))
    told = clusters.select(F.col("node").alias("class"), F.col("component").alias("cluster")).join(classes, "class")
    sizes = told.groupBy("cluster").agg(F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK_DOCS), F.ceil(F.sum("n") / BLOCK_GRAMS)).alias("blocks"))
    wanted = materialise(told.join(sizes, "cluster").select("class", "cluster", "blocks", "first_id", "first_sign"), "gram-clusters")
    # Always by shuffle: wanted grows with the data, so it is not one to broadcast at any size.
    met = docs.join(wanted.hint("merge"), F.col("id").eqNullSafe(F.col("first_id")) & (F.col("sign") == F.col("first_sign"))).select("id", "text", "cluster", "blocks", "class")
    members = materialise(met.mapInArrow(cut, "cluster bigint, blocks bigint, class bigint, grams binary").withColumn("block", F.pmod(F.xxhash64("class"), F.col("blocks"))), "gram-members")
    alone = F.col("class").alias("known")
    # Each block with itself and the first block of its cluster.
    with_first = members.where((F.col("block") == 0) & (F.col("blocks") > 1)).withColumn("block", F.explode(F.sequence(F.lit(1), F.col("blocks") - 1)))
    first = materialise(link_blocks(members.unionByName(with_first).withColumn("known", alone), percent), "gram-links")
    many = members.where("blocks > 1")
    if many.isEmpty():
        return nodes_of(first)
    of_many = many.select(F.col("class").alias("u")).distinct()
    whole, parted = first.join(of_many, "u", "left_anti"), first.join(of_many, "u", "left_semi")
    so_far = components(parted).select(F.col("node").alias("class"), F.col("component").alias("known"))
    labelled = materialise(many.join(so_far, "class", "left").withColumn("known", F.coalesce("known", "class")), "gram-labelled")
    largest = labelled.groupBy("cluster", "known").count().groupBy("cluster").agg(F.max(F.struct("count", "known"))["known"].alias("largest"))
    rest = labelled.join(largest, "cluster").where("known <> largest").drop("largest")
    # The rest, itself in parts, against every block: parts and blocks make new block numbers.
    parts_of = rest.groupBy("cluster").agg(F.ceil(F.count(F.lit(1)) / BLOCK_DOCS).alias("parts"))
    rest = rest.join(parts_of, "cluster").withColumn("part", F.pmod(F.xxhash64("class", F.lit(1)), F.col("parts")))
    asked = rest.withColumn("against", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("block", F.col("part") * F.col("blocks") + F.col("against"))
    held = labelled.join(parts_of, "cluster").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumn("block", F.col("part") * F.col("blocks") + F.col("block"))
    columns = ["cluster", "block", "class", "known", "grams"]
    second = link_blocks(held.select(columns).unionByName(asked.select(columns)), percent)
    joined = labelled.select(F.col("class").alias("u"), F.col("known").alias("v"))
    return nodes_of(whole).unionByName(components(joined.unionByName(second)))


def keyed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, text and sign of the rows of df; rows that agree in id and sign have one text."""
    return df.select(F.col(id_col).cast("bigint").alias("id"), text_of(text_col).alias("text"), F.xxhash64(text_of(text_col)).alias("sign"))


def grouped_classes(df: DataFrame, words: int, percent: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(id, sign, n, class) of every row, and (class, component, first_id) of every class that is not empty."""
    docs = keyed(df, id_col, text_col)
    surveyed = survey(docs, words)
    clusters = components(materialise(candidate_edges(postings(docs, sketch_of(surveyed), words, percent), percent), "gram-candidates"))
    linked = linked_classes(docs, surveyed, clusters, words, percent)
    told = surveyed.where(F.col("slice").isNull()).select("id", "sign", "n", "class")
    classes = told.where("n > 0").groupBy("class").agg(F.min("id").alias("first_id"))
    return told, classes.join(linked.withColumnRenamed("node", "class"), "class", "left").withColumn("component", F.coalesce("component", "class"))


def jaccard_components(df: DataFrame, words: int = 3, percent: int = 90, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_shingles, component_id of every row of df; texts link when 100 * overlap >= percent * union."""
    told, grouped = grouped_classes(df, words, percent, id_col, text_col)
    of_component = grouped.groupBy("component").agg(F.min("first_id").alias("component_id"))
    # Written, so that the last join shuffles both sides and a hot class can be split.
    of_class = materialise(grouped.join(of_component, "component").select("class", "component_id"), "gram-components")
    full = told.where("n > 0").join(of_class, "class").select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id")
    return full.unionByName(told.where("n = 0").select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("id").alias("component_id")))


def one_of_each(df: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """df's rows without near copies: of each component the row with the smallest id, a null id last.

    Rows stay by id and text, not by id alone. Of a component's rows with one id and different texts one stays,
    by a hash of the text, and of rows that agree in id and text one. Texts without words all stay.
    """
    told, grouped = grouped_classes(df, words, percent, id_col, text_col)
    of_class = materialise(grouped.select("class", "component"), "gram-components")
    lone = F.col("id").isNull().alias("lone")
    first = told.where("n > 0").join(of_class, "class").groupBy("component").agg(F.min(F.struct(lone, F.coalesce("id", F.lit(0)).alias("i"), "sign")).alias("row"))
    empty = told.where("n = 0").select(lone, F.coalesce("id", F.lit(0)).alias("i"), "sign").distinct()
    kept = materialise(first.select("row.*", F.lit(False).alias("every")).unionByName(empty.withColumn("every", F.lit(True))), "gram-kept")
    kept = kept.select(*(F.col(c).alias(f"__{c}") for c in kept.columns))
    marked = df.withColumns({"__lone": F.col(id_col).isNull(), "__i": F.coalesce(F.col(id_col).cast("bigint"), F.lit(0)), "__sign": F.xxhash64(text_of(text_col))})
    keys = ["__lone", "__i", "__sign"]
    # The window lies on the join's own partitions.
    met = marked.join(kept.hint("merge"), keys).withColumn("__nth", F.row_number().over(Window.partitionBy(*keys).orderBy(*keys)))
    return met.where("__every or __nth = 1").select(*df.columns)
