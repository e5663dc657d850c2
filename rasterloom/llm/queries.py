"""The queries of the training-data operators and, where SQL can express them, their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents
from .dac_tokens import read_documents, write_shards
from .exact_dedup import DigestIndex, dedup_batches
from .fill_in_middle import fill_in_middle, restored
from .jaccard_join import jaccard_components
from .language_id import language
from .lm_scoring import score_documents
from .mixing import plan_mix
from .packing import pack_documents
from .token_counts import token_counts
from .topk_search import top_k
from .toxicity import toxicity
from .warc_index import archive_and_read
from .whitening import whiten

#: Context length of the over_limit column.
TOKEN_LIMIT = 1024


def op1_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_and_read(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(documents(spark, sf_dir)).withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(documents(spark, sf_dir))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    first = F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0
    return dedup_batches([docs.where(first), docs.where(~first)], DigestIndex(spark))


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_documents(write_shards(documents(spark, sf_dir)))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(documents(spark, sf_dir))


def op8_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = plan_mix(documents(spark, sf_dir))
    return plan.select("doc_id", "size", "source_size", "target", (F.col("size") * F.size("shards")).alias("taken"))


def op9_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(documents(spark, sf_dir))


def op11_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language(documents(spark, sf_dir))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = fill_in_middle(documents(spark, sf_dir).select("doc_id", "text"))
    return cut.select(
        "doc_id", F.col("fim_n").alias("n"), F.col("fim_form").alias("form"), F.col("fim_prefix_chars").alias("prefix_chars"), F.col("fim_middle_chars").alias("middle_chars"),
        F.sha2(F.col("fim_output"), 256).alias("output_sha256"), F.sha2(restored(F.col("fim_output"), F.col("fim_form")), 256).alias("restored_sha256"),
    )


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP4_SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS points,
         sha256(translate(coalesce(text, ''), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '')) AS text_sha256
  FROM documents
), w AS (
  SELECT *, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY points DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY text_sha256) AS group_size
  FROM d
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM w
"""

OP8_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce('=' || source, '') AS key,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5('17|' || coalesce(doc_id::VARCHAR, md5(coalesce(text, '')))) AS perm
  FROM documents
), s AS (
  SELECT key, sum(size)::BIGINT AS source_size FROM d GROUP BY key
), n AS (
  SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][((row_number() OVER (ORDER BY (key = '')::INT, key) - 1) % 3 + 1)::INT] AS weight,
         source_size * 2.0::DOUBLE AS cap, sum(source_size) OVER ()::DOUBLE * 1.5::DOUBLE AS whole
  FROM s
), l AS (
  SELECT *, cap / weight AS ratio,
         (whole - coalesce(sum(cap) OVER (ORDER BY cap / weight, key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(weight) OVER (ORDER BY cap / weight, key ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM n
), t AS (
  SELECT key, source_size,
         CASE WHEN ratio <= level THEN cap
              ELSE weight * (SELECT arg_min(level, (ratio, key)) FROM l WHERE ratio > level) END AS target
  FROM l
), c AS (
  SELECT d.*, t.source_size, t.target,
         CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size) ELSE 0 END AS passes,
         sum(d.size) OVER (PARTITION BY d.key ORDER BY d.perm, d.doc_id, d.size ROWS UNBOUNDED PRECEDING) - d.size AS before
  FROM d JOIN t USING (key)
)
SELECT doc_id, size, source_size, target,
       (size * (passes + CASE WHEN before * 2 + size <= (target - passes * source_size) * 2 THEN 1 ELSE 0 END))::BIGINT AS taken
FROM c
"""


OP9_SQL = r"""
WITH c AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 64)::BIGINT) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), p AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i]))::BIGINT AS score
  FROM c q JOIN c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM p
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""

OP1_SQL = r"""
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages
), k AS (
  SELECT *, max(page_id) OVER (PARTITION BY hex) AS keeper FROM p
)
SELECT page_id, url, payload_bytes::BIGINT AS payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(hex, (1 + (i // 4) * 5)::INT, 5))::INT >> (15 - 5 * (i % 4))::INT) & 31), 1)), '') AS payload_digest,
       CASE WHEN page_id = keeper THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> keeper THEN keeper END AS refers_to
FROM k JOIN pages USING (page_id)
"""

OP7_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM d
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), o AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id
), l AS (
  SELECT x, y FROM o JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * k >= 90 * (p.n + q.n - k)
), e AS (
  SELECT x, y FROM l UNION ALL SELECT y, x FROM l
), r AS (
  SELECT doc_id AS node, doc_id AS seen FROM n UNION SELECT r.node, e.y FROM r JOIN e ON e.x = r.seen
)
SELECT d.doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, coalesce(min(r.seen), d.doc_id) AS component_id
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN r ON r.node = d.doc_id GROUP BY d.doc_id
"""

OP12_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS t,
         sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS hex
  FROM documents
), h AS (
  SELECT *, list_transform(range(4), lambda k: ('0x' || substr(hex, (8 * k + 1)::INT, 8))::BIGINT) AS h FROM d
), c AS (
  SELECT *, least(h[1] % (len(t) + 1), h[2] % (len(t) + 1)) AS a, greatest(h[1] % (len(t) + 1), h[2] % (len(t) + 1)) AS b,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h[3] % 100 >= 50 THEN 'plain'
              WHEN h[4] % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
  FROM h
), p AS (
  SELECT *, array_to_string(t[1:a], '') AS prefix, array_to_string(t[a + 1:b], '') AS middle, array_to_string(t[b + 1:], '') AS suffix FROM c
)
SELECT doc_id, len(t)::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM p
"""

QUERIES = (
    op1_warc_index, op2_token_counts, op3_best_fit_packing, op4_exact_dedup, op5_token_files, op6_toxicity, op7_jaccard_join, op8_source_mix, op9_exact_top_k, op10_lm_scoring,
    op11_language, op12_fill_in_middle, op13_whitening,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    return {"op1_warc_index": OP1_SQL, "op7_jaccard_join": OP7_SQL, "op4_exact_dedup": OP4_SQL, "op8_source_mix": OP8_SQL, "op9_exact_top_k": OP9_SQL, "op12_fill_in_middle": OP12_SQL}
