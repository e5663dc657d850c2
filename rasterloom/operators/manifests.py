"""Comparisons of file manifests (path, sha256), as equi-joins on the path."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The order in which differences are told.
KINDS = ("missing", "extra", "changed")


def missing(expected: DataFrame, actual: DataFrame) -> DataFrame:
    return expected.join(actual.select("path"), "path", "left_anti").select("path")


def changed(expected: DataFrame, actual: DataFrame) -> DataFrame:
    return expected.join(actual.withColumnRenamed("sha256", "now"), "path").where("sha256 <> now").select("path")


def difference(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """path, kind and its rank, from one full outer join."""
    met = expected.withColumnRenamed("sha256", "was").join(actual.withColumnRenamed("sha256", "now"), "path", "full_outer")
    kind = F.when(F.col("now").isNull(), "missing").when(F.col("was").isNull(), "extra").when(F.col("was") != F.col("now"), "changed")
    rank = F.when(kind == "missing", 1).when(kind == "extra", 2).otherwise(3)
    return met.select("path", kind.alias("kind"), rank.alias("rank")).where(F.col("kind").isNotNull())
