"""Queries on model metadata: catalogue look-ups, freshness, readiness, labels and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..registry import query
from .fixtures import WEIGHTS, table, weights

#: The models on offer (index, name in menus, edge method, backend, type, weights file, MB); a model with a
#: backend is assisted by Canny edges.
MODELS = (
    (0, "Canny", "canny", None, None, None, None),
    (1, "LSD", "lsd", None, None, None, None),
    (2, "HED", "hed", None, None, None, 56),
    (3, "MobileSAM", "canny", "mobile_sam", "vit_t", "mobile_sam.pt", 39),
    (4, "SAM", "canny", "segment_anything", "vit_b", "sam_vit_b_01ec64.pth", 358),
)
MODEL_SCHEMA = "model_idx int, mode string, method string, backend string, model_type string, filename string, size_mb int"
MODELS_SQL = "models(model_idx, mode, method, backend, model_type, filename, size_mb) AS (VALUES " + ", ".join("(" + ", ".join("NULL" if v is None else repr(v) for v in m) + ")" for m in MODELS) + ")"
#: Where weights may be fetched from.
ALLOWED_HOSTS, ALLOWED_SCHEMES = ("raw.githubusercontent.com", "vcl.ucsd.edu"), ("https",)


def models(spark):
    """The catalogue: a table of five rows, small enough to broadcast at any data size."""
    return F.broadcast(spark.createDataFrame(MODELS, MODEL_SCHEMA))


ASKED = "asked AS (SELECT event_id, (event_id % 7)::INT AS model_idx, ['ko', 'en', 'fr'][(event_id % 3 + 1)::INT] AS lang FROM events)"


def asked(spark, sf_dir):
    lang = F.element_at(F.array(F.lit("ko"), F.lit("en"), F.lit("fr")), (F.col("event_id") % 3 + 1).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", (F.col("event_id") % 7).cast("int").alias("model_idx"), lang.alias("lang"))


@query("method_for_model", f"WITH {MODELS_SQL}, {ASKED} SELECT event_id, model_idx, coalesce(method, 'canny') AS method FROM asked LEFT JOIN models USING (model_idx)")
def method_for_model(spark, sf_dir):
    return asked(spark, sf_dir).join(models(spark), "model_idx", "left").select("event_id", "model_idx", F.coalesce("method", F.lit("canny")).alias("method"))


@query("model_spec_lookup", f"WITH {MODELS_SQL}, {ASKED} SELECT event_id, backend, model_type, filename, size_mb, CASE WHEN backend IS NULL THEN 'unsupported model ' || model_idx END AS error FROM asked LEFT JOIN models USING (model_idx)")
def model_spec_lookup(spark, sf_dir):
    error = F.when(F.col("backend").isNull(), F.concat(F.lit("unsupported model "), "model_idx"))
    return asked(spark, sf_dir).join(models(spark), "model_idx", "left").select("event_id", "backend", "model_type", "filename", "size_mb", error.alias("error"))


@query("localized_label", f"""WITH {ASKED} SELECT event_id, coalesce(map_extract_value(m, lang), map_extract_value(m, 'ko')) AS label
FROM (SELECT *, MAP {{'ko': '선택', 'en': 'Select'}} AS m FROM asked)""")
def localized_label(spark, sf_dir):
    told = F.create_map(F.lit("ko"), F.lit("선택"), F.lit("en"), F.lit("Select"))
    return asked(spark, sf_dir).select("event_id", F.coalesce(F.try_element_at(told, F.col("lang")), F.try_element_at(told, F.lit("ko"))).alias("label"))


@query("kv_settings", f"WITH {ASKED} SELECT event_id, coalesce(CASE WHEN event_id % 4 <> 0 THEN lang END, CASE WHEN event_id % 8 = 0 THEN 'ko' END, 'en') AS language FROM asked")
def kv_settings(spark, sf_dir):
    i = F.col("event_id")
    return asked(spark, sf_dir).select("event_id", F.coalesce(F.when(i % 4 != 0, F.col("lang")), F.when(i % 8 == 0, F.lit("ko")), F.lit("en")).alias("language"))


DISPLAY_SQL = f"""WITH {MODELS_SQL}, named AS (SELECT model_idx,
  CASE WHEN backend = 'segment_anything' THEN 'SAM (' || upper(model_type) || ')' ELSE mode END AS name,
  CASE WHEN mode = 'HED' THEN 'Download HED' WHEN backend IS NULL THEN 'Download Model'
       ELSE 'Download ' || mode || CASE WHEN size_mb > 0 THEN ' (~' || size_mb || 'MB)' ELSE '' END END AS label FROM models)
SELECT doc_id, model_idx, name, label FROM (SELECT doc_id, (doc_id % 6)::INT AS model_idx FROM labels) JOIN named USING (model_idx)"""


@query("display_name", DISPLAY_SQL)
def display_name(spark, sf_dir):
    """What the model that a document's label asks for (doc_id % 6; there is no model 5) is called, and what its download button says."""
    backend, mode = F.col("backend"), F.col("mode")
    name = F.when(backend == "segment_anything", F.concat(F.lit("SAM ("), F.upper("model_type"), F.lit(")"))).otherwise(mode)
    size = F.when(F.col("size_mb") > 0, F.concat(F.lit(" (~"), "size_mb", F.lit("MB)"))).otherwise("")
    label = F.when(mode == "HED", "Download HED").when(backend.isNull(), "Download Model").otherwise(F.concat(F.lit("Download "), mode, size))
    models = spark.createDataFrame(MODELS, MODEL_SCHEMA).select("model_idx", name.alias("name"), label.alias("label"))
    asked = table(spark, sf_dir, "labels").select("doc_id", (F.col("doc_id") % 6).cast("int").alias("model_idx"))
    return asked.join(F.broadcast(models), "model_idx").select("doc_id", "model_idx", "name", "label")  # the catalogue, five rows


STATUS_SQL = f"""{WEIGHTS}, status AS (SELECT l.key, CASE
  WHEN r.key IS NULL OR NOT r.ok THEN 'check_failed' WHEN NOT l.present THEN 'not_installed'
  WHEN l.etag <> '' AND r.etag <> '' AND l.etag <> r.etag THEN 'update_available'
  WHEN l.size <> 0 AND r.content_length <> 0 AND l.size <> r.content_length THEN 'update_available'
  WHEN coalesce(r.etag, '') = '' AND l.last_modified <> '' AND r.last_modified <> '' AND l.last_modified <> r.last_modified THEN 'update_available'
  WHEN coalesce(r.etag, '') = '' AND coalesce(r.last_modified, '') = '' AND coalesce(r.content_length, 0) = 0 THEN 'unknown' ELSE 'up_to_date' END AS status
FROM weights_local l LEFT JOIN weights_remote r ON l.key = r.key)"""


def update_status():
    """The first test that applies to local and remote metadata decides; empty and zero values skip a test."""
    differ = lambda a, b: (F.col(a) != "") & (F.col(b) != "") & (F.col(a) != F.col(b))
    no = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    return (
        F.when(F.col("r.key").isNull() | ~F.col("r.ok"), "check_failed").when(~F.col("l.present"), "not_installed")
        .when(differ("l.etag", "r.etag"), "update_available")
        .when((F.col("l.size") != 0) & (F.col("r.content_length") != 0) & (F.col("l.size") != F.col("r.content_length")), "update_available")
        .when(no("r.etag") & differ("l.last_modified", "r.last_modified"), "update_available")
        .when(no("r.etag") & no("r.last_modified") & (F.coalesce("r.content_length", F.lit(0)) == 0), "unknown").otherwise("up_to_date")
    )


@query("weights_update_check", f"WITH {STATUS_SQL} SELECT key, status FROM status")
def weights_update_check(spark, sf_dir):
    """Whether weights are current."""
    local, remote = weights(spark, sf_dir)
    met = local.alias("l").join(remote.alias("r"), F.col("l.key") == F.col("r.key"), "left")
    return met.select("l.key", update_status().alias("status"))


@query("local_weights_info", f"WITH {WEIGHTS} SELECT d.doc_id AS key, coalesce(l.present, false) AS present, coalesce(l.size, 0) AS size, l.etag, l.last_modified FROM documents d LEFT JOIN weights_local l ON d.doc_id = l.key")
def local_weights_info(spark, sf_dir):
    local, _ = weights(spark, sf_dir)
    keys = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("key"))
    return keys.join(local, "key", "left").select("key", F.coalesce("present", F.lit(False)).alias("present"), F.coalesce("size", F.lit(0)).alias("size"), "etag", "last_modified")


#: What to do about each update status, and what is said of any other.
ADVICE = {
    "not_installed": "SAM weights are missing. Download is recommended.",
    "update_available": "A newer SAM weights file appears available. Update is recommended.",
    "up_to_date": "SAM weights appear up-to-date.",
    "unknown": "Could not compare exact versions. Re-download if you suspect mismatch.",
    "check_failed": "Version check failed. Verify internet/proxy/firewall and retry.",
}
NO_ADVICE = "No recommendation."
#: The tone of a message by the reason why a runtime is ready or not; any other is an error.
TONES = {"ready": "info", "missing_prototxt": "warning", "missing_weights": "warning"}


def choose(value, table, other):
    """The entry of a small fixed table, as a CASE."""
    out = F
    for k, v in table.items():
        out = out.when(value == k, v)
    return out.otherwise(other)


def choose_sql(value: str, table: dict[str, str], other: str) -> str:
    return f"CASE {value} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table.items()) + f" ELSE '{other}' END"


@query("recommendation", f"WITH {STATUS_SQL} SELECT key, status, {choose_sql('status', ADVICE, NO_ADVICE)} AS advice FROM status")
def recommendation(spark, sf_dir):
    """What the update status of each weights file asks for."""
    return weights_update_check(spark, sf_dir).select("key", "status", choose(F.col("status"), ADVICE, NO_ADVICE).alias("advice"))


FACTS = "facts AS (SELECT doc_id AS id, doc_id % 2 = 0 AS has_cv, doc_id % 3 <> 0 AS has_proto, doc_id % 5 <> 0 AS has_weights, doc_id % 7 <> 0 AS loads, doc_id % 4 <> 1 AS backend FROM documents)"


def facts(spark, sf_dir):
    i = F.col("doc_id")
    return table(spark, sf_dir, "documents").select(i.alias("id"), (i % 2 == 0).alias("has_cv"), (i % 3 != 0).alias("has_proto"), (i % 5 != 0).alias("has_weights"), (i % 7 != 0).alias("loads"), (i % 4 != 1).alias("backend"))


@query("runtime_status", f"WITH {FACTS} SELECT id, CASE WHEN NOT has_cv THEN 'missing_opencv' WHEN NOT has_proto THEN 'missing_prototxt' WHEN NOT has_weights THEN 'missing_weights' WHEN NOT loads THEN 'invalid_runtime' ELSE 'ready' END AS reason, has_cv AND has_proto AND has_weights AND loads AS ok, " + choose_sql("reason", TONES, "error") + " AS tone FROM facts")
def runtime_status(spark, sf_dir):
    reason = F.when(~F.col("has_cv"), "missing_opencv").when(~F.col("has_proto"), "missing_prototxt").when(~F.col("has_weights"), "missing_weights").when(~F.col("loads"), "invalid_runtime").otherwise("ready")
    return facts(spark, sf_dir).select("id", reason.alias("reason"), (reason == "ready").alias("ok"), choose(reason, TONES, "error").alias("tone"))


@query("sam_readiness", f"WITH {FACTS} SELECT id, CASE WHEN NOT backend THEN 'not installed' WHEN loads AND has_cv THEN 'loaded' WHEN loads THEN 'blocked' WHEN has_weights THEN 'download again' ELSE 'file needed' END AS state FROM facts")
def sam_readiness(spark, sf_dir):
    c = F.col
    state = F.when(~c("backend"), "not installed").when(c("loads") & c("has_cv"), "loaded").when(c("loads"), "blocked").when(c("has_weights"), "download again").otherwise("file needed")
    return facts(spark, sf_dir).select("id", state.alias("state"))


@query("module_inventory", "SELECT n AS module, count(p_name) > 0 AS present, max(p_size) AS version FROM (SELECT DISTINCT p_type AS n FROM part UNION SELECT 'absent module') LEFT JOIN part ON p_type = n AND p_size > 40 GROUP BY n")
def module_inventory(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    wanted = part.select(F.col("p_type").alias("module")).union(spark.range(1).select(F.lit("absent module").alias("module"))).distinct()
    installed = part.where("p_size > 40").groupBy(F.col("p_type").alias("module")).agg(F.max("p_size").alias("version"))
    return wanted.join(installed, "module", "left").select("module", F.col("version").isNotNull().alias("present"), "version")


@query("read_meta_json", "SELECT event_id, CASE WHEN event_id % 6 <> 0 THEN json_extract_string(props, '$.k')::BIGINT END AS k FROM events")
def read_meta_json(spark, sf_dir):
    """Unreadable metadata reads as nulls."""
    raw = F.when(F.col("event_id") % 6 == 0, F.lit("{broken")).otherwise(F.col("props"))
    return table(spark, sf_dir, "events").select("event_id", F.from_json(raw, "k bigint", {"mode": "PERMISSIVE"})["k"].alias("k"))


@query("write_meta_json", f"WITH {WEIGHTS} SELECT key, '{{\"etag\":\"' || coalesce(etag, '') || '\",\"content_length\":' || coalesce(content_length, 0) || '}}' AS meta FROM weights_remote")
@query("json_report", f"WITH {WEIGHTS} SELECT key, '{{\"etag\":\"' || coalesce(etag, '') || '\",\"content_length\":' || coalesce(content_length, 0) || '}}' AS meta FROM weights_remote")
def write_meta_json(spark, sf_dir):
    return weights(spark, sf_dir)[1].select("key", F.to_json(F.struct(F.coalesce("etag", F.lit("")).alias("etag"), F.coalesce("content_length", F.lit(0)).alias("content_length"))).alias("meta"))


@query("parse_remote_headers", f"WITH {WEIGHTS} SELECT key, etag, last_modified, try_cast(CASE WHEN key % 9 = 0 THEN 'n/a' ELSE content_length::VARCHAR END AS BIGINT) AS content_length FROM weights_remote")
def parse_remote_headers(spark, sf_dir):
    raw = F.when(F.col("key") % 9 == 0, F.lit("n/a")).otherwise(F.col("content_length").cast("string"))
    headers = F.create_map(F.lit("ETag"), F.col("etag"), F.lit("Last-Modified"), F.col("last_modified"), F.lit("Content-Length"), raw)
    told = weights(spark, sf_dir)[1].withColumn("h", headers)
    return told.select("key", F.col("h")["ETag"].alias("etag"), F.col("h")["Last-Modified"].alias("last_modified"), F.col("h")["Content-Length"].try_cast("bigint").alias("content_length"))


@query("source_remote_headers", f"WITH {WEIGHTS} SELECT key, CASE WHEN NOT ok THEN 'failed' WHEN content_length IS NULL AND etag IS NULL THEN 'get' ELSE 'head' END AS via FROM weights_remote")
def source_remote_headers(spark, sf_dir):
    """How each record was fetched: a head request, or a get where that told neither length nor tag."""
    return weights(spark, sf_dir)[1].select("key", F.when(~F.col("ok"), "failed").when(F.col("content_length").isNull() & F.col("etag").isNull(), "get").otherwise("head").alias("via"))


HOSTS_SQL = ", ".join(f"'{h}'" for h in ALLOWED_HOSTS)


@query("url_allowlist", f"""WITH asked AS (SELECT page_id, url FROM pages UNION ALL SELECT -page_id, regexp_replace(url, '^[a-z]+://[^/:?#]*', CASE page_id % 3 WHEN 0 THEN 'https://VCL.ucsd.edu' WHEN 1 THEN 'https://notvcl.ucsd.edu' ELSE 'HTTPS://raw.githubusercontent.com' END) FROM pages)
SELECT page_id, url, CASE WHEN lower(regexp_extract(url, '^([A-Za-z]+):', 1)) <> 'https' THEN 'scheme' WHEN lower(regexp_extract(url, '^[A-Za-z]+://([^/:?#]*)', 1)) NOT IN ({HOSTS_SQL}) THEN 'host' END AS error FROM asked""")
def url_allowlist(spark, sf_dir):
    """Why a download is refused: its scheme or its host is not one of those allowed, in any case of letters."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    i = F.col("page_id")
    at = F.when(i % 3 == 0, "https://VCL.ucsd.edu").when(i % 3 == 1, "https://notvcl.ucsd.edu").otherwise("HTTPS://raw.githubusercontent.com")
    moved = pages.select((-i).alias("page_id"), F.regexp_replace("url", F.lit("^[a-z]+://[^/:?#]*"), at).alias("url"))
    part = lambda p: F.lower(F.coalesce(F.try_parse_url("url", F.lit(p)), F.lit("")))
    error = F.when(~part("PROTOCOL").isin(*ALLOWED_SCHEMES), "scheme").when(~part("HOST").isin(*ALLOWED_HOSTS), "host")
    return pages.unionByName(moved).select("page_id", "url", error.alias("error"))


@query("format_size", """SELECT doc_id, CASE WHEN n IS NULL THEN '?' WHEN n < 1024 THEN printf('%.1fB', n) WHEN n < 1048576 THEN printf('%.1fKB', n / 1024.0::DOUBLE) WHEN n < 1073741824 THEN printf('%.1fMB', n / 1048576.0::DOUBLE) ELSE printf('%.1fGB', n / 1073741824.0::DOUBLE) END AS size
FROM (SELECT doc_id, CASE WHEN doc_id % 10 <> 0 THEN (n_chars * (CASE WHEN doc_id % 3 = 0 THEN 1 WHEN doc_id % 3 = 1 THEN 1000 ELSE 1000000 END))::DOUBLE END AS n FROM documents)""")
def format_size(spark, sf_dir):
    i = F.col("doc_id")
    n = F.when(i % 10 != 0, (F.col("n_chars") * F.when(i % 3 == 0, 1).when(i % 3 == 1, 1000).otherwise(1000000)).cast("double"))
    size = F.when(n.isNull(), "?")
    for limit, unit, name in ((1024, 1, "B"), (1048576, 1024, "KB"), (1073741824, 1048576, "MB"), (None, 1073741824, "GB")):
        told = F.format_string(f"%.1f{name}", F.bround(n / F.lit(float(unit)), 1))
        size = size.when(n < limit, told) if limit else size.otherwise(told)
    return table(spark, sf_dir, "documents").select("doc_id", size.alias("size"))


@query("path_strings", """SELECT page_id, list_last(string_split(url, '/')) AS base, lower(regexp_extract(url, '\\.([^./]*)$', 1)) AS ext, list_last(string_split(url, '.')) AS last_part,
  CASE WHEN ends_with(lower(url), '.shp') THEN url ELSE url || '.shp' END AS file FROM pages""")
def path_strings(spark, sf_dir):
    u = F.col("url")
    return table(spark, sf_dir, "pages").select(
        "page_id", F.substring_index(u, "/", -1).alias("base"), F.lower(F.regexp_extract(u, r"\.([^./]*)$", 1)).alias("ext"), F.substring_index(u, ".", -1).alias("last_part"), F.when(F.lower(u).endswith(".shp"), u).otherwise(F.concat(u, F.lit(".shp"))).alias("file")
    )


@query("ini_version", "SELECT doc_id, regexp_extract('[general]' || chr(10) || 'name=x' || chr(10) || 'version=1.' || (doc_id % 9) || chr(10) || 'author=y', '(?m)^version=(.*)$', 1) AS version FROM documents")
def ini_version(spark, sf_dir):
    ini = F.concat(F.lit("[general]\nname=x\nversion=1."), F.col("doc_id") % 9, F.lit("\nauthor=y"))
    return table(spark, sf_dir, "documents").select("doc_id", F.regexp_extract(ini, "(?m)^version=(.*)$", 1).alias("version"))


@query("array_ops", """SELECT vec_id, list_reverse(embedding[1:4]) AS reversed, embedding[3:5] || embedding[64:64] AS joined, list_position(embedding, list_min(embedding))::INT AS argmin FROM embeddings""")
def array_ops(spark, sf_dir):
    e = F.col("embedding")
    return table(spark, sf_dir, "embeddings").select(
        "vec_id", F.reverse(F.slice(e, 1, 4)).alias("reversed"), F.concat(F.slice(e, 3, 3), F.slice(e, 64, 1)).alias("joined"), F.array_position(e, F.array_min(e)).cast("int").alias("argmin")
    )


@query("math_scalars", """SELECT event_id, round(sqrt(value), 6) AS root, round(sqrt(value * value + k * k), 6) AS hyp, round(atan2(k, value), 6) AS angle, round(radians(value), 6) AS rad, abs(value - 200) AS away,
  trunc(value / 7)::INT AS whole, round_even(value / 2, 0) AS even, least(greatest(value, 10.0::DOUBLE), 100.0::DOUBLE) AS clipped FROM (SELECT event_id, value, json_extract(props, '$.k')::DOUBLE AS k FROM events)""")
def math_scalars(spark, sf_dir):
    v, k = F.col("value"), F.get_json_object("props", "$.k").cast("double")
    return table(spark, sf_dir, "events").select(
        "event_id", F.round(F.sqrt(v), 6).alias("root"), F.round(F.hypot(v, k), 6).alias("hyp"), F.round(F.atan2(k, v), 6).alias("angle"), F.round(F.radians(v), 6).alias("rad"), F.abs(v - 200).alias("away"),
        (v / 7).cast("int").alias("whole"), F.bround(v / 2, 0).alias("even"), F.least(F.greatest(v, F.lit(10.0)), F.lit(100.0)).alias("clipped"),
    )


#: Raster sample types by name, their bytes and what holds them; and by bytes alone.
SAMPLE_TYPES = {"Byte": (1, "u8"), "UInt16": (2, "u16"), "Int16": (2, "i16"), "UInt32": (4, "u32"), "Int32": (4, "i32"), "Float32": (4, "f32"), "Float64": (8, "f64")}
BY_BYTES = {1: "u8", 2: "u16", 4: "f32", 8: "f64"}
REJECTED = ("UnknownDataType", "ARGB32", "ARGB32_Premultiplied", "CInt16", "CInt32", "CFloat32", "CFloat64")
TYPE_NAMES = (*SAMPLE_TYPES, *REJECTED, "Odd")
TYPES_SQL = "[" + ", ".join(f"'{n}'" for n in TYPE_NAMES) + "]"
KNOWN_SQL = "known(name, size, held) AS (VALUES " + ", ".join(f"('{n}', {b}, '{h}')" for n, (b, h) in SAMPLE_TYPES.items()) + ")"


@query("decode_dtype", f"""WITH {KNOWN_SQL}, t AS (SELECT o_orderkey AS id, 'Qgis.' || {TYPES_SQL}[(o_orderkey % {len(TYPE_NAMES)} + 1)::INT] AS told, [1, 2, 4, 8, 3][(o_custkey % 5 + 1)::INT] AS bytes FROM orders)
SELECT id, CASE WHEN list_last(string_split(told, '.')) IN ({", ".join(f"'{r}'" for r in REJECTED)}) THEN NULL WHEN size IS NOT NULL THEN CASE WHEN size = bytes THEN held END ELSE CASE bytes WHEN 1 THEN 'u8' WHEN 2 THEN 'u16' WHEN 4 THEN 'f32' WHEN 8 THEN 'f64' END END AS held
FROM t LEFT JOIN known ON name = list_last(string_split(told, '.'))""")
def decode_dtype(spark, sf_dir):
    """The sample type by its name, else by size alone; NULL for types that cannot be read and where a known type has another size."""
    o = table(spark, sf_dir, "orders")
    name = F.element_at(F.array(*map(F.lit, TYPE_NAMES)), (F.col("o_orderkey") % len(TYPE_NAMES) + 1).cast("int"))
    told = o.select(F.col("o_orderkey").alias("id"), F.concat(F.lit("Qgis."), name).alias("told"), F.element_at(F.array(*map(F.lit, (1, 2, 4, 8, 3))), (F.col("o_custkey") % 5 + 1).cast("int")).alias("bytes"))
    last = F.substring_index("told", ".", -1)
    table_of = lambda d: F.create_map(*(F.lit(x) for kv in d.items() for x in kv))
    size, held = F.try_element_at(table_of({n: b for n, (b, _) in SAMPLE_TYPES.items()}), last), F.try_element_at(table_of({n: h for n, (_, h) in SAMPLE_TYPES.items()}), last)
    return told.select("id", F.when(last.isin(*REJECTED), None).when(size.isNotNull(), F.when(size == F.col("bytes"), held)).otherwise(F.try_element_at(table_of(BY_BYTES), F.col("bytes"))).alias("held"))
