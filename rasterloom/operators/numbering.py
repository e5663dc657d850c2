"""Gapless numbers within keys, where one key may hold all rows.

Rows are dealt by ranges of (key, order), so a large key is several partitions; each counts its rows of a key, a prefix
sum over the counts, one row a partition and key, says where each goes on, and rows are numbered inside their partition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.layers import written_table


def number_rows(df: DataFrame, key: str, order: str, name: str = "number") -> DataFrame:
    """df with the rank, from 1, of each row among those of its key by order; rows that agree in both are in any order."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = written_table(df.repartitionByRange(parts, key, order).withColumn("__part", F.spark_partition_id()), "ranges")
    counts = dealt.groupBy(F.col(key).alias("__key"), F.col("__part").alias("__of")).agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy("__key").orderBy("__of").rowsBetween(Window.unboundedPreceding, -1)  # a row a partition
    starts = counts.select("__key", "__of", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    inside = F.row_number().over(Window.partitionBy("__part", key).orderBy(order))
    told = dealt.withColumn("__at", inside).join(starts, F.col(key).eqNullSafe(F.col("__key")) & (F.col("__part") == F.col("__of")))
    return told.select(*df.columns, (F.col("__start") + F.col("__at")).alias(name))
