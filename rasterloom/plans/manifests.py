"""Queries on file manifests: hashes, differences, set operations, totals and filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import manifests as ops
from ..registry import query
from .fixtures import MANIFESTS, manifests, table

#: What a package leaves out, and its size limit in MB.
SKIPPED_NAMES, SKIPPED_ENDINGS, LIMIT_MB = ("__pycache__", ".git", ".DS_Store"), (".pyc", ".pyo", ".zip"), 25


@query("manifest_missing", f"WITH {MANIFESTS} SELECT path FROM expected WHERE path NOT IN (SELECT path FROM actual)")
def manifest_missing(spark, sf_dir):
    return ops.missing(*manifests(spark, sf_dir))


@query("manifest_extra", f"WITH {MANIFESTS} SELECT path FROM actual WHERE path NOT IN (SELECT path FROM expected)")
def manifest_extra(spark, sf_dir):
    return ops.missing(*manifests(spark, sf_dir)[::-1])


@query("manifest_changed", f"WITH {MANIFESTS} SELECT path FROM expected e JOIN actual a USING (path) WHERE e.sha256 <> a.sha256")
def manifest_changed(spark, sf_dir):
    return ops.changed(*manifests(spark, sf_dir))


DIFF = f"""WITH {MANIFESTS}, d AS (
  SELECT coalesce(e.path, a.path) AS path, CASE WHEN a.path IS NULL THEN 'missing' WHEN e.path IS NULL THEN 'extra' WHEN e.sha256 <> a.sha256 THEN 'changed' END AS kind
  FROM expected e FULL OUTER JOIN actual a ON e.path = a.path)
SELECT path, kind, CASE kind WHEN 'missing' THEN 1 WHEN 'extra' THEN 2 ELSE 3 END AS rank FROM d WHERE kind IS NOT NULL ORDER BY rank, path"""


@query("manifest_diff", DIFF)
def manifest_diff(spark, sf_dir):
    return ops.difference(*manifests(spark, sf_dir)).orderBy("rank", "path")


@query("set_difference", f"WITH {MANIFESTS} SELECT path FROM expected EXCEPT SELECT path FROM actual")
def set_difference(spark, sf_dir):
    expected, actual = manifests(spark, sf_dir)
    return expected.select("path").subtract(actual.select("path"))


@query("set_intersection", f"WITH {MANIFESTS} SELECT path FROM expected INTERSECT SELECT path FROM actual")
def set_intersection(spark, sf_dir):
    expected, actual = manifests(spark, sf_dir)
    return expected.select("path").intersect(actual.select("path"))


@query("source_manifest", "SELECT source || '/' || doc_id AS path, sha256(text) AS sha256 FROM documents ORDER BY path")
@query("sorted_manifest", "SELECT source || '/' || doc_id AS path, sha256(text) AS sha256 FROM documents ORDER BY path")
def sorted_manifest(spark, sf_dir):
    return manifests(spark, sf_dir)[0].orderBy("path")


@query("content_sha256", "SELECT doc_id, sha256(text) AS sha256, octet_length(encode(text))::BIGINT AS n_bytes FROM documents")
def content_sha256(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"), F.octet_length("text").cast("bigint").alias("n_bytes"))


@query("limit_sample", f"WITH {MANIFESTS} SELECT path FROM actual ORDER BY path LIMIT 50")
def limit_sample(spark, sf_dir):
    return manifests(spark, sf_dir)[1].select("path").orderBy("path").limit(50)


def skipped(name):
    """Whether a package leaves a path out: by a part of it, by its ending, or as model weights."""
    parts = F.split(name, "/")
    ending = F.lower(F.regexp_extract(F.element_at(parts, -1), r"(\.[^.]*)$", 1))
    return F.arrays_overlap(parts, F.array(*map(F.lit, SKIPPED_NAMES))) | ending.isin(*SKIPPED_ENDINGS) | (F.array_contains(parts, "models") & ending.isin(".pth", ".caffemodel"))


PATHS = """paths AS (
  SELECT page_id, regexp_replace(url, '^[a-z]+://[^/]*', '') || CASE WHEN page_id % 7 = 0 THEN '/x.pyc' WHEN page_id % 11 = 0 THEN '/__pycache__/y' WHEN page_id % 13 = 0 THEN '/models/w.pth' WHEN page_id % 5 = 0 THEN '/A.ZIP' ELSE '/keep.py' END AS name,
         octet_length(encode(html)) AS size FROM pages)"""
SKIP_SQL = """(list_has_any(string_split(name, '/'), ['__pycache__', '.git', '.DS_Store']) OR lower(regexp_extract(list_last(string_split(name, '/')), '(\\.[^.]*)$', 1)) IN ('.pyc', '.pyo', '.zip')
  OR (list_contains(string_split(name, '/'), 'models') AND lower(regexp_extract(list_last(string_split(name, '/')), '(\\.[^.]*)$', 1)) IN ('.pth', '.caffemodel')))"""


def paths(spark, sf_dir):
    i = F.col("page_id")
    tail = F.when(i % 7 == 0, "/x.pyc").when(i % 11 == 0, "/__pycache__/y").when(i % 13 == 0, "/models/w.pth").when(i % 5 == 0, "/A.ZIP").otherwise("/keep.py")
    return table(spark, sf_dir, "pages").select("page_id", F.concat(F.regexp_replace("url", "^[a-z]+://[^/]*", ""), tail).alias("name"), F.octet_length("html").alias("size"))


@query("path_skip_filter", f"WITH {PATHS} SELECT page_id, name FROM paths WHERE NOT {SKIP_SQL}")
def path_skip_filter(spark, sf_dir):
    return paths(spark, sf_dir).where(~skipped(F.col("name"))).select("page_id", "name")


@query("package_totals", f"""WITH {PATHS}, s AS (SELECT *, {SKIP_SQL} AS skip FROM paths)
SELECT count(*) FILTER (NOT skip) AS added, count(*) FILTER (skip) AS skipped, round(coalesce(sum(size) FILTER (NOT skip), 0)::DOUBLE / 1048576.0::DOUBLE, 6) AS size_mb,
       CASE WHEN coalesce(sum(size) FILTER (NOT skip), 0)::DOUBLE / 1048576.0::DOUBLE > 25 THEN 'too large' ELSE 'ok' END AS verdict FROM s""")
def package_totals(spark, sf_dir):
    told = paths(spark, sf_dir).withColumn("skip", skipped(F.col("name")))
    mb = F.coalesce(F.sum(F.when(~F.col("skip"), F.col("size"))), F.lit(0)).cast("double") / F.lit(1048576.0)
    return told.agg(F.count_if(~F.col("skip")).alias("added"), F.count_if("skip").alias("skipped"), F.round(mb, 6).alias("size_mb"), F.when(mb > LIMIT_MB, "too large").otherwise("ok").alias("verdict"))
