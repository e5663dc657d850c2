"""Exact deduplication against a persistent digest index.

The index is a table bucketed and sorted by the SHA-256 of the normalised text, one row a digest.
A new batch is reduced to one row a digest (map-side combined, so a group of copies of any size
shrinks before the shuffle), anti-joined with the index by sort-merge join - the index side is
read as it lies, without a shuffle; each bucket is sorted once more, as it may have several files -
and what is new is appended. Rows then learn their
group's fate by a join of two shuffled sides, whose hot digests adaptive execution splits.

Defined results: a null text counts as empty, and empty texts form one group; a null id loses
against any id; of rows that agree in length, id and text, one stays; other columns are ignored.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WHITESPACE, materialise, partitions, shared_path, text_of


def text_digest(column: str = "text") -> Column:
    """Lowercase hex SHA-256 of the text without any character of WHITESPACE; replacing works on the bytes as they are."""
    text = text_of(column)
    for c in WHITESPACE:
        text = F.replace(text, F.lit(c), F.lit(""))
    return F.sha2(text, 256)


class DigestIndex:
    """A table (digest, keep_id, keep_row, points, batch) in buckets by digest, at a path that outlives the session.

    The number of buckets belongs to the path: it is written beside the table when that is made, read when it is opened again,
    whatever the session's partitions are then, and an opener who asks for another is refused.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int | None = None):
        self.spark, self.path = spark, path or shared_path(spark, "digest-index")
        self.buckets, self.table = self._bucket_count(buckets), f"digest_index_{uuid.uuid4().hex}"
        spark.sql(
            f"CREATE TABLE {self.table} (digest STRING, keep_id BIGINT, keep_row BIGINT, points INT, batch STRING) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{self.path}'"
        )

    def _bucket_count(self, wanted: int | None) -> int:
        beside = f"{self.path}-buckets"
        there = lambda p: (q := self.spark._jvm.org.apache.hadoop.fs.Path(p)).getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(q)
        if there(beside):
            stored = self.spark.read.parquet(beside).first()["buckets"]
            if wanted not in (None, stored):
                raise ValueError(f"the index at {self.path} has {stored} buckets, not {wanted}")
            return stored
        if there(self.path):
            raise ValueError(f"{self.path} is there, but not its number of buckets ({beside})")
        self.spark.range(1).select(F.lit(wanted or partitions(self.spark)).alias("buckets")).write.parquet(beside)
        return wanted or partitions(self.spark)

    def rows(self) -> DataFrame:
        return self.spark.table(self.table)

    def best(self) -> DataFrame:
        """digest, keep_id, keep_row, batch: of each digest the best row of all batches, found bucket by bucket without a shuffle."""
        row = F.max(F.struct("points", F.bitwise_not("keep_id").alias("rank"), F.bitwise_not("keep_row").alias("row_rank"), "batch")).alias("b")
        return self.rows().groupBy("digest").agg(row).select("digest", F.bitwise_not("b.rank").alias("keep_id"), F.bitwise_not("b.row_rank").alias("keep_row"), "b.batch", "b.points")

    def unseen(self, digests: DataFrame) -> DataFrame:
        """The rows of digests, one a digest, that the index lacks."""
        return digests.hint("merge").join(self.rows().select("digest"), "digest", "left_anti")

    def append(self, rows: DataFrame) -> None:
        rows.write.mode("append").format("parquet").bucketBy(self.buckets, "digest").sortBy("digest").saveAsTable(self.table)


def fold_batch(df: DataFrame, index: DigestIndex, id_col: str, text_col: str, better: bool = False) -> tuple[DataFrame, str, DataFrame]:
    """(digests of df's rows, name of the batch, groups of equal texts), after the index has learned what is new; both tables
    are written. With better, it also learns where the batch has a better row for a digest that it knows."""
    batch = uuid.uuid4().hex
    hashed = materialise(
        df.select(F.col(id_col).cast("bigint").alias("id"), text_digest(text_col).alias("digest"), F.length(text_of(text_col)).alias("points"), F.monotonically_increasing_id().alias("row")),
        "dedup-digests",
    )
    # ~id falls as id rises and cannot overflow; null sorts below every id.
    best = F.max(F.struct("points", F.bitwise_not("id").alias("rank"), F.bitwise_not("row").alias("row_rank")))
    groups = materialise(hashed.groupBy("digest").agg(best.alias("best"), F.count(F.lit(1)).alias("group_size")), "dedup-groups")
    row = lambda g: g.select("digest", F.bitwise_not("best.rank").alias("keep_id"), F.bitwise_not("best.row_rank").alias("keep_row"), F.col("best.points").alias("points"), F.lit(batch).alias("batch"))
    new = row(index.unseen(groups))
    if better:
        known = index.best().select("digest", F.struct(F.col("points").alias("points"), F.bitwise_not("keep_id").alias("rank")).alias("known"))
        ahead = groups.hint("merge").join(known, "digest").where(F.struct(F.col("best.points").alias("points"), F.col("best.rank").alias("rank")) > F.col("known"))
        new = materialise(new.unionByName(row(ahead)), "dedup-new")  # the index is read before it is written
    index.append(new)
    return hashed, batch, groups


def dedup_batches(parts: list[DataFrame], index: DigestIndex, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of all parts, id, keep_id, group_size, kept, text_sha256, after the index has learned the parts one by one.

    Each part is deduplicated against what the index holds of those before it. Of equal texts, wherever they came, the
    longest original, then the smallest id stays; group_size counts the rows of all parts.
    """
    folded = [fold_batch(part, index, id_col, text_col, better=True) for part in parts]
    rows, sizes = None, None
    for hashed, batch, groups in folded:
        told, size = hashed.withColumn("of", F.lit(batch)), groups.select("digest", "group_size")
        rows, sizes = (told, size) if rows is None else (rows.unionByName(told), sizes.unionByName(size))
    # Written, so that the last join shuffles both sides and a hot digest can be split.
    fates = materialise(sizes.groupBy("digest").agg(F.sum("group_size").alias("group_size")).hint("merge").join(index.best(), "digest"), "dedup-fates")
    kept = (F.col("batch") == F.col("of")) & (F.col("row") == F.col("keep_row"))
    return rows.join(fates, "digest").select(F.col("id").alias(id_col), "keep_id", "group_size", kept.alias("kept"), F.col("digest").alias("text_sha256"))


def dedup_batch(df: DataFrame, index: DigestIndex, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of df: id, keep_id, group_size, kept, text_sha256.

    Of equal texts the longest original, then the smallest id, stays, unless the index holds the
    digest from an earlier batch: then none of the batch stays and keep_id names the earlier row.
    group_size counts the rows of this batch.
    """
    hashed, batch, groups = fold_batch(df, index, id_col, text_col)
    # Written, so that the last join shuffles both sides and a hot digest can be split.
    fates = materialise(groups.select("digest", "group_size").hint("merge").join(index.rows(), "digest"), "dedup-fates")
    kept = (F.col("batch") == batch) & (F.col("row") == F.col("keep_row"))
    return hashed.join(fates, "digest").select(F.col("id").alias(id_col), "keep_id", "group_size", kept.alias("kept"), F.col("digest").alias("text_sha256"))


def keep_distinct(df: DataFrame, index: DigestIndex, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of df that stay, with df's columns: of equal texts the longest original, then the smallest id.

    Of rows that agree in both, the one whose text has the smallest hash stays, so that reruns agree.
    """
    batch, groups = fold_batch(df, index, id_col, text_col)[1:]
    new = groups.join(index.rows().where(F.col("batch") == batch).select("digest"), "digest", "left_semi")
    row = {"__digest": F.col("digest"), "__points": F.col("best.points"), "__rank": F.coalesce("best.rank", F.lit(0)), "__lone": F.col("best.rank").isNull()}
    kept = materialise(new.select(*(c.alias(k) for k, c in row.items())), "dedup-kept")
    rank = F.bitwise_not(F.col(id_col).cast("bigint"))
    marked = df.withColumns({"__digest": text_digest(text_col), "__points": F.length(text_of(text_col)), "__rank": F.coalesce(rank, F.lit(0)), "__lone": rank.isNull()})
    # The window lies on the join's own partitions; copies with other ids or lengths lie elsewhere.
    here = Window.partitionBy(*row).orderBy(F.xxhash64(text_of(text_col)), F.col(text_col).isNull())
    return marked.join(kept.hint("merge"), list(row)).withColumn("__nth", F.row_number().over(here)).where("__nth = 1").select(*df.columns)
