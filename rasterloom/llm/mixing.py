"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Sizes are counted once into a narrow table. Every document has a place in a seeded random
permutation (the MD5 of seed and id); the first hex digits of it cut each source into blocks.
A source's target is met by whole passes over its blocks and one partial pass that takes whole
blocks in permuted order and splits only its boundary block. So a source has an exact quota of block
draws, at most (passes + 1) * BLOCKS.

The quotas of all sources are the root of a binary tree. A node passes half of its draws to the
left: how many of each source follows the multivariate hypergeometric distribution, drawn source by
source as conditional hypergeometric counts from a seeded hash (first over BANDS bands of sources,
then inside each band, so no task sees all sources). A leaf is an output shard with an exact quota of
each source. It draws that many blocks, a run of the source's permuted draws that no other leaf has,
and what a document is taken is what the leaves have drawn of its block. Inside a shard rows are
ordered by a second permutation.

Only DataFrame functions run. Documents meet their block by a join on (source, block), so a hot
source spreads over BLOCKS keys; the block table has at most BLOCKS rows a source.

Defined results: a null text has size 0; a null source is a source of its own, last in order;
documents of size 0 and sources of size 0 have taken 0; a null id is placed by the text's MD5; repeated
rows are rows of their own; a column of df named like the shard's leaves that name to df.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, materialise, text_of

#: Hex digits of the permutation that name a block, and so the number of blocks of a source.
BLOCK_DIGITS = 3
BLOCKS = 16**BLOCK_DIGITS
#: Bands of sources in a node of the tree.
BANDS = 64


def source_key(column: str) -> Column:
    """A key without null that no other source has."""
    return F.coalesce(F.concat(F.lit("="), F.col(column)), F.lit(""))


def source_targets(sizes: DataFrame, weights: list[int], share: float, most: float) -> DataFrame:
    """key, source_size, target: share of all sizes by weight, no source above most times its size.

    Water-filling in closed form: with sources in the order of cap to weight, those before the
    first whose cap exceeds the level that is left stop at their cap.
    """
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    by_name = Window.orderBy(F.when(F.col("key") == "", 1).otherwise(0), "key")
    filling = Window.orderBy("ratio", "key")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("n") % len(weights) + 1).cast("int"))
    before = filling.rowsBetween(Window.unboundedPreceding, -1)
    from_here = filling.rowsBetween(0, Window.unboundedFollowing)
    total = F.sum("source_size").over(every)
    return (
        sizes.groupBy("key").agg(F.sum("size").alias("source_size"))
        .withColumn("n", F.row_number().over(by_name) - 1)
        .withColumns({"weight": weight.cast("double"), "cap": F.col("source_size") * F.lit(float(most))})
        .withColumn("ratio", F.col("cap") / F.col("weight"))
        .withColumn("level", (total * F.lit(float(share)) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(from_here))
        .withColumn("capped", F.col("ratio") <= F.col("level"))
        # The level at the first source that stays below its cap holds for all after it.
        .withColumn("common", F.min(F.when(~F.col("capped"), F.struct("ratio", "key", "level"))).over(every)["level"])
        .withColumn("target", F.when(F.col("capped"), F.col("cap")).otherwise(F.col("common") * F.col("weight")))
        .select("key", "source_size", "target")
    )


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), value being computed once however often use names it."""
    return F.transform(F.array(value), use)[0]


def hypergeometric(total: Column, ours: Column, drawn: Column, u: Column) -> Column:
    """How many of our items are among drawn ones of total, by inversion at u in [0, 1).

    The distribution is cut off eight standard deviations and eight items from its mean, inside its support.
    """
    n, k, m = total.cast("double"), ours.cast("double"), drawn.cast("double")
    mean = F.when(n > 0, m * k / n).otherwise(0.0)
    reach = F.when(n > 1, 8 * F.sqrt(m * k * (n - k) * (n - m) / (n * n * (n - 1)))).otherwise(0.0) + 8
    low = F.greatest(F.lit(0), drawn - (total - ours), F.floor(mean - reach)).cast("bigint")
    high = F.least(drawn, ours, F.ceil(mean + reach)).cast("bigint")

    def walk(x: Column) -> Column:
        """Weights of the numbers in steps, each from the one before, as their sums so far."""

        def step(s: Column, i: Column) -> Column:
            ratio = (k - i) * (m - i) / ((i + 1) * F.greatest(n - k - m + i + 1, F.lit(1.0)))
            return let(s["sum"] + s["weight"], lambda grown: F.struct((s["weight"] * ratio).alias("weight"), grown.alias("sum"), F.array_append(s["sums"], grown).alias("sums")))

        start = F.struct(F.lit(1.0).alias("weight"), F.lit(0.0).alias("sum"), F.array().cast("array<double>").alias("sums"))
        return F.aggregate(x, start, step)["sums"]

    def choose(sums: Column) -> Column:
        limit = u * F.element_at(sums, -1)
        return F.size(F.filter(sums, lambda s: s <= limit))

    return let(F.struct(low.alias("low"), high.alias("high")), lambda b: F.least(b["low"] + let(walk(F.sequence(b["low"], b["high"])), choose), b["high"]))


def summed(counts: Column) -> Column:
    return F.aggregate(counts, F.lit(0).cast("bigint"), lambda a, x: a + x)


def split_counts(counts: Column, drawn: Column, seed: Column) -> Column:
    """Multivariate hypergeometric: how many of each of the counts are among drawn ones, as an array in their order."""
    start = F.struct(F.array().cast("array<bigint>").alias("left"), summed(counts).alias("total"), drawn.cast("bigint").alias("drawn"))

    def step(s: Column, x: Column) -> Column:
        lot = F.shiftrightunsigned(F.xxhash64(seed, F.size(s["left"])), 11) / F.lit(float(1 << 53))
        taken = F.when(x == 0, F.lit(0).cast("bigint")).otherwise(hypergeometric(s["total"], x, s["drawn"], lot))
        return let(taken, lambda t: F.struct(F.array_append(s["left"], t).alias("left"), (s["total"] - x).alias("total"), (s["drawn"] - t).alias("drawn")))

    return F.aggregate(counts, start, step)["left"]


def split_nodes(rows: DataFrame, depth: int, drawn: Callable[[int, Column, Column], Column], seed: Callable[[int, Column], Column]) -> DataFrame:
    """rows with nodes0, an array of the root's counts alone, gets left0, nodes1, left1, ... down to nodes<depth>: on each
    level the array of what every node passes to the left, and the nodes of the next level, left and right in turn.
    drawn(level, counts, node) is how many a node passes to the left in all."""
    for level in range(depth):
        nodes, left = F.col(f"nodes{level}"), F.col(f"left{level}")
        rows = rows.withColumn(f"left{level}", F.transform(nodes, lambda q, i: split_counts(q, drawn(level, q, i), seed(level, i))))  # noqa: B023
        both = F.zip_with(nodes, left, lambda q, n: F.array(n, F.zip_with(q, n, lambda a, b: a - b)))
        rows = rows.withColumn(f"nodes{level + 1}", F.flatten(both))
    return rows


def split_tree(quotas: DataFrame, depth: int, seed: int) -> DataFrame:
    """(node, key, quota) of the tree's leaves, 2**depth of them, from the root's (key, quota).

    The quotas of the bands are split first, in one row of at most BANDS numbers a node; then each band splits its
    sources' quotas, told by the bands how many a node passes to the left.
    """
    band = F.pmod(F.xxhash64("key"), F.lit(BANDS)).alias("band")
    told = quotas.where("quota > 0").groupBy(band).agg(F.array_sort(F.collect_list(F.struct("key", "quota"))).alias("entries"))
    inside = told.select("band", F.transform("entries", lambda e: e["key"]).alias("keys"), F.array(F.transform("entries", lambda e: e["quota"])).alias("nodes0"))
    inside = materialise(inside, "mix-bands")
    bands = inside.groupBy().agg(F.array_sort(F.collect_list(F.struct("band", summed(F.col("nodes0")[0]).alias("quota")))).alias("bands"))
    root = bands.select(F.transform("bands", lambda b: b["band"]).alias("names"), F.array(F.transform("bands", lambda b: b["quota"])).alias("nodes0"))
    half = lambda level, q, i: F.floor((summed(q) + 1) / 2)
    outer = split_nodes(root, depth, half, lambda level, i: F.concat_ws("|", F.lit(f"{seed}:{level}"), i.cast("string")))
    lefts = [F.transform(f"left{level}", lambda q: F.element_at(q, F.col("at") + 1)).alias(f"given{level}") for level in range(depth)]
    given = outer.select(F.posexplode("names").alias("at", "band"), *(f"left{level}" for level in range(depth))).select("band", *lefts)
    met = inside.join(materialise(given, "mix-given"), "band")
    own = lambda level, i: F.concat_ws("|", F.lit(f"{seed}:{level}:in"), F.col("band").cast("string"), i.cast("string"))
    split = split_nodes(met, depth, lambda level, q, i: F.element_at(f"given{level}", i + 1), own)
    leaves = split.select("keys", F.posexplode(f"nodes{depth}").alias("node", "quotas"))
    return leaves.select("node", F.explode(F.arrays_zip(F.col("keys").alias("key"), F.col("quotas").alias("quota"))).alias("e")).select("node", "e.key", "e.quota").where("quota > 0")


def plan_mix(df: DataFrame, weights: list[int] = (5, 2, 1), share: float = 1.5, most: float = 2.0, shard_depth: int = 4, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per row of df: id, source, size, source_size, target, shards (one for each time it is taken), perm, sign."""
    named = F.coalesce(F.col(id_col).cast("string"), F.md5(text_of(text_col)))
    sized = materialise(
        df.select(
            F.col(id_col).alias("id"), source_key(source_col).alias("key"), F.regexp_count(text_of(text_col), F.lit(WORD)).cast("bigint").alias("size"),
            F.md5(F.concat_ws("|", F.lit(str(seed)), named)).alias("perm"), row_sign(text_col, source_col).alias("sign"),
        ).withColumn("block", F.substring("perm", 1, BLOCK_DIGITS)),
        "mix-sizes",
    )
    targets = source_targets(sized, list(weights), share, most)
    along = Window.partitionBy("key").orderBy("block")
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("int")
    blocks = materialise(
        sized.groupBy("key", "block").agg(F.sum("size").alias("block_size"))
        .withColumn("start", F.sum("block_size").over(along) - F.col("block_size"))
        .join(targets, "key")
        .withColumn("passes", passes)
        .withColumn("rest", F.col("target") - F.col("passes") * F.col("source_size"))
        .withColumn("boundary", (F.col("start") < F.col("rest")) & (F.col("start") + F.col("block_size") > F.col("rest"))),
        "mix-blocks",
    )
    # A source's draws in permuted order; the last pass stops at the boundary.
    pass_ = blocks.withColumn("pass", F.explode(F.sequence(F.lit(1), F.col("passes") + 1))).where((F.col("pass") <= F.col("passes")) | (F.col("start") < F.col("rest")))
    lot = F.md5(F.concat_ws("|", F.lit(f"{seed}:draw"), "key", "block", "pass"))
    draws = pass_.select("key", "block", "pass", (F.row_number().over(Window.partitionBy("key").orderBy(lot, "block", "pass")) - 1).alias("nth"))
    leaves = split_tree(draws.groupBy("key").agg(F.count(F.lit(1)).alias("quota")), shard_depth, seed)
    first = (F.sum("quota").over(Window.partitionBy("key").orderBy("node")) - F.col("quota")).alias("first")
    runs = leaves.select("key", first, F.col("node").cast("int").alias("node"), "quota").groupBy("key").agg(F.collect_list(F.struct("first", "quota", "node")).alias("runs"))
    mine = F.filter("runs", lambda r: (r["first"] <= F.col("nth")) & (F.col("nth") < r["first"] + r["quota"]))
    drawn = draws.join(runs, "key").select("key", "block", F.explode(mine).alias("run"), "pass")
    taken = drawn.groupBy("key", "block").agg(F.array_sort(F.collect_list(F.struct("pass", F.col("run.node").alias("shard")))).alias("drawn"))
    plan = materialise(blocks.join(taken, ["key", "block"], "left").select("key", "block", "start", "source_size", "target", "passes", "rest", "boundary", "drawn"), "mix-plan")
    met = sized.join(plan, ["key", "block"])
    # Only the boundary block of a source is ordered; the others are taken as they were drawn.
    inside = Window.partitionBy("key", "block").orderBy("perm", "id", "size", "sign").rowsBetween(Window.unboundedPreceding, 0)
    split = (
        met.where("boundary").withColumn("before", F.col("start") + F.sum("size").over(inside) - F.col("size"))
        .withColumn("last", F.col("before") * 2 + F.col("size") <= F.col("rest") * 2).drop("before")
    )
    every = split.unionByName(met.where("not boundary").withColumn("last", F.lit(True)))
    mine = F.filter("drawn", lambda d: (F.col("size") > 0) & ((d["pass"] <= F.col("passes")) | F.col("last")))
    shards = F.coalesce(F.transform(mine, lambda d: d["shard"]), F.array().cast("array<int>"))
    return every.select(F.col("id").alias(id_col), F.when(F.col("key") != "", F.expr("substring(key, 2)")).alias(source_col), "size", "source_size", "target", shards.alias("shards"), "perm", "sign")


def row_sign(text_col: str, source_col: str) -> Column:
    """Rows that agree in id and sign agree in text and source."""
    return F.xxhash64(text_of(text_col), source_key(source_col))


def mixed_rows(df: DataFrame, plan: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 17) -> DataFrame:
    """df's rows, each as often as the plan takes it, and last its shard (named shard, with underscores while df has that name).

    Every partition holds its part of a shard in permuted order, so that writing by shard needs no further
    shuffle. plan is plan_mix(df): rows that agree in id, text and source share the plan's rows in turn.
    """
    name = "shard"
    while name in df.columns:
        name += "_"
    keys = {"__lone": F.col(id_col).isNull(), "__id": F.coalesce(F.col(id_col).cast("string"), F.lit(""))}
    nth = Window.partitionBy("__lone", "__id", "__sign").orderBy("__order")
    mine = df.withColumns({**keys, "__sign": row_sign(text_col, source_col), "__order": F.lit(0)}).withColumn("__nth", F.row_number().over(nth))
    takes = plan.select(F.col(id_col), F.col("sign").alias("__sign"), F.col("shards").alias("__shards"), F.size("shards").alias("__order")).withColumns(keys)
    takes = takes.withColumn("__nth", F.row_number().over(nth)).select("__lone", "__id", "__sign", "__nth", "__shards")
    met = mine.join(takes, ["__lone", "__id", "__sign", "__nth"])
    lot = F.md5(F.concat_ws("|", F.lit(f"{seed}:in"), "__copy", "__id", F.col("__sign").cast("string")))
    drawn = met.select(*df.columns, "__id", "__sign", F.posexplode("__shards").alias("__copy", "__shard"))
    return drawn.sortWithinPartitions("__shard", lot).select(*df.columns, F.col("__shard").alias(name))
