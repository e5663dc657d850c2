"""Exact and near duplicates, mixing, search, archives, toxicity and scores against brute force and awkward rows."""

from __future__ import annotations

import base64
import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

from rasterloom.llm import exact_dedup, jaccard_join, lm_scoring, mixing, topk_search, toxicity, warc_index
from rasterloom.llm.components import components
from rasterloom.llm.word_hash import hash_words

from . import cases


def normal(text):
    return re.sub(r"[\x20\x09-\x0d]", "", text or "")


def test_exact_copies(spark):
    got = exact_dedup.dedup_batch(cases.docs(spark), exact_dedup.DigestIndex(spark)).collect()
    groups = collections.defaultdict(list)
    for i, t in cases.TEXTS:
        groups[normal(t)].append((-len(t or ""), math.inf if i is None else i, i))
    want = collections.Counter()
    for i, t in cases.TEXTS:
        g = groups[normal(t)]
        want[(i, min(g)[2], len(g), hashlib.sha256(normal(t).encode()).hexdigest())] += 1
    assert collections.Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == want
    assert sum(r.kept for r in got) == len(groups)
    assert exact_dedup.dedup_batch(cases.none(spark), exact_dedup.DigestIndex(spark)).count() == 0


def test_index_remembers_batches(spark):
    index = exact_dedup.DigestIndex(spark)
    first = cases.docs(spark, [(1, "a b"), (2, "c")])
    second = cases.docs(spark, [(0, "ab"), (3, "d"), (4, "d "), (5, "c")])
    assert all(r.kept for r in exact_dedup.dedup_batch(first, index).collect())
    got = {r.doc_id: (r.keep_id, r.kept) for r in exact_dedup.dedup_batch(second, index).collect()}
    assert got == {0: (1, False), 3: (4, False), 4: (4, True), 5: (2, False)}
    again = exact_dedup.DigestIndex(spark, index.path, index.buckets)
    assert again.rows().count() == 3 and again.unseen(index.rows().select("digest")).count() == 0


def test_index_keeps_its_buckets_whatever_the_session_has(spark):
    texts = [(i, f"text number {i}") for i in range(200)]
    index = exact_dedup.DigestIndex(spark, buckets=16)
    assert exact_dedup.dedup_batch(cases.docs(spark, texts), index).where("kept").count() == 200
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for partitions in ("4", "16", "7"):
            spark.conf.set("spark.sql.shuffle.partitions", partitions)
            again = exact_dedup.DigestIndex(spark, index.path)
            assert again.buckets == 16 and exact_dedup.dedup_batch(cases.docs(spark, texts), again).where("kept").count() == 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    with pytest.raises(ValueError, match="16 buckets"):
        exact_dedup.DigestIndex(spark, index.path, 8)


def test_batches_agree_with_one(spark):
    texts = [*cases.TEXTS, *((100 + i, "x" * (i % 7) + " " * (i % 5)) for i in range(60))]
    want = collections.Counter(map(tuple, exact_dedup.dedup_batch(cases.docs(spark, texts), exact_dedup.DigestIndex(spark)).collect()))
    parts = [cases.docs(spark, texts[k::3]) for k in range(3)]
    index = exact_dedup.DigestIndex(spark)
    assert collections.Counter(map(tuple, exact_dedup.dedup_batches(parts, index).collect())) == want
    assert index.rows().count() > index.best().count() == len({normal(t) for _, t in texts})
    assert exact_dedup.dedup_batches([cases.none(spark), cases.none(spark)], exact_dedup.DigestIndex(spark)).count() == 0


def test_kept_rows_have_their_columns(spark):
    df = cases.docs(spark)
    kept = exact_dedup.keep_distinct(df, exact_dedup.DigestIndex(spark))
    assert kept.columns == df.columns and kept.count() == len({normal(t) for _, t in cases.TEXTS})


def grams(text, k):
    w = cases.words(text)
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def brute_components(texts, k, percent):
    sets = [(i, grams(t, k)) for i, t in texts]
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                parent[find(a)] = find(b)
    least = collections.defaultdict(list)
    for a, (i, _) in enumerate(sets):
        if i is not None:
            least[find(a)].append(i)
    return collections.Counter((i, len(s), i if not s else min(least[find(a)], default=None)) for a, (i, s) in enumerate(sets))


@pytest.mark.parametrize("k, percent", [(3, 90), (5, 80)])
def test_near_copies(spark, monkeypatch, k, percent):
    monkeypatch.setattr(jaccard_join, "BLOCK_DOCS", 40)
    rng = random.Random(5)
    base = [f"w{rng.randint(0, 400)}" for _ in range(90)]
    texts = [t for t in cases.TEXTS if t[0] != 8]
    for i in range(220):
        x = list(base)
        for _ in range(rng.randint(0, 4)):
            x[rng.randrange(90)] = f"z{rng.randint(0, 60)}"
        texts.append((100 + i, " ".join(x)))
    texts += [(400 + i, " ".join([*base[:40], *(f"own{i}x{j}" for j in range(60))])) for i in range(90)]  # a shared passage
    got = jaccard_join.jaccard_components(cases.docs(spark, texts, 5), k, percent).collect()
    assert collections.Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute_components(texts, k, percent)


def test_no_documents_to_join(spark):
    assert jaccard_join.jaccard_components(cases.none(spark)).count() == 0
    assert jaccard_join.jaccard_components(cases.docs(spark, [(1, None), (2, "")])).count() == 2


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 103), (103, 101)], "u long, v long")
    got = dict(map(tuple, components(edges).collect()))
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100, 103: 100}


def test_word_hashes_follow_words():
    import pyarrow as pa

    texts = ["A bc\td", None, "", "bc a", " x\x0b", "BC", "é É"]
    h, n = hash_words(pa.array(texts))
    assert n.tolist() == [3, 0, 0, 2, 1, 1, 2]
    assert h[0] == h[4] and h[1] == h[3] == h[6] and h[7] != h[8] and len(set(h.tolist())) == 6


def test_mixture_meets_its_targets(spark):
    df = spark.createDataFrame([(i, "w " * (i % 17), f"s{i % 4}" if i % 9 else None) for i in range(3000)], "doc_id long, text string, source string").repartition(4)
    plan = mixing.plan_mix(df)
    rows = plan.collect()
    by = collections.defaultdict(list)
    for r in rows:
        by[r.source].append(r)
    assert len(rows) == 3000 and abs(sum(v[0].target for v in by.values()) - 1.5 * sum(r.size for r in rows)) < 1
    for v in by.values():
        assert v[0].source_size == sum(r.size for r in v) and v[0].target <= 2 * v[0].source_size + 1e-6
        assert abs(sum(r.size * len(r.shards) for r in v) - v[0].target) <= 17
    assert all(len(r.shards) <= 2 for r in rows)
    assert sorted(map(tuple, plan.select("doc_id", "shards").collect())) == sorted(map(tuple, mixing.plan_mix(df.repartition(7)).select("doc_id", "shards").collect()))
    mixed = mixing.mixed_rows(df, plan)
    assert mixed.count() == sum(len(r.shards) for r in rows) and mixed.columns == [*df.columns, "shard"]
    shards = collections.Counter(r.shard for r in mixed.select("shard").collect())
    assert len(shards) == 16 and max(shards.values()) < 2 * min(shards.values())


def test_tree_keeps_quotas(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BANDS", 3)
    quotas = {f"k{i}": n for i, n in enumerate([0, 1, 2, 5, 40, 41, 300, 7, 0, 12000])}
    root = spark.createDataFrame(list(quotas.items()), "key string, quota long")
    whole = sum(quotas.values())
    for depth in range(4):
        leaves = collections.defaultdict(dict)
        for r in mixing.split_tree(root, depth, 5).collect():
            leaves[r.node][r.key] = r.quota
        assert len(leaves) == 2**depth and {k: sum(v.get(k, 0) for v in leaves.values()) for k in quotas} == quotas
        sizes = [sum(v.values()) for v in leaves.values()]
        assert max(sizes) - min(sizes) <= depth and sum(sizes) == whole


def test_hypergeometric_draws(spark):
    """The inverted draws have the distribution's mean and variance, and never leave its support."""
    from pyspark.sql import functions as F

    cases_ = [(50, 20, 25), (10, 10, 5), (10, 0, 5), (7, 3, 7), (2, 1, 1), (4000, 100, 2000)]
    df = spark.range(4000).crossJoin(spark.createDataFrame(cases_, "total long, ours long, drawn long"))
    got = df.select("total", "ours", "drawn", mixing.hypergeometric(F.col("total"), F.col("ours"), F.col("drawn"), (F.col("id") + 0.5) / 4000).alias("k"))
    for r in got.groupBy("total", "ours", "drawn").agg(F.avg("k").alias("mean"), F.var_pop("k").alias("var"), F.min("k").alias("low"), F.max("k").alias("high")).collect():
        n, k, m = r.total, r.ours, r.drawn
        assert abs(r.mean - m * k / n) < 0.01 + 0.001 * k and max(0, m - n + k) <= r.low <= r.high <= min(m, k)
        assert abs(r["var"] - (m * k * (n - k) * (n - m) / (n * n * (n - 1)))) <= 0.01 * (1 + r["var"])


def test_mixture_of_awkward_rows(spark):
    docs = cases.docs(spark)
    plan = mixing.plan_mix(docs)
    rows = plan.collect()
    assert collections.Counter((r.doc_id, r.size) for r in rows) == collections.Counter((i, len(cases.words(t))) for i, t in cases.TEXTS)
    assert all(r.shards == [] for r in rows if r.size == 0)
    mixed = mixing.mixed_rows(docs, plan)
    assert mixed.columns == [*docs.columns, "shard_"] and mixed.count() == sum(len(r.shards) for r in rows)
    assert mixing.plan_mix(cases.none(spark)).count() == 0


def test_top_k_of_awkward_vectors(spark):
    rng = np.random.default_rng(2)
    vectors = [(i, rng.normal(size=8).round(1).tolist()) for i in range(300)]
    vectors += [(20, None), (40, [1.0, None]), (60, [float("nan")] * 8), (80, [float("inf")] * 8), (1000, [0.5] * 3), (1001, []), (1020, [1e6] * 8)] + [(2000 + i, [0.5] * 8) for i in range(60)]
    got = topk_search.top_k(spark.createDataFrame([(*v, "x", 1) for v in vectors], "vec_id long, embedding array<double>, score string, id int").repartition(3)).collect()
    whole = [(i, [math.floor(64 * x) for x in v]) for i, v in vectors if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    want = set()
    for q, a in whole:
        if q % 20 == 0:
            best = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in whole if i != q)[:20]
            want |= {(q, k + 1, i, -s) for k, (s, i) in enumerate(best)}
    assert {tuple(r) for r in got} == want
    assert topk_search.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_top_k_with_null_ids_is_as_in_sql(spark, tmp_path):
    import duckdb

    from rasterloom.llm.queries import OP9_SQL
    from tests.oracle import difference

    rng = np.random.default_rng(3)
    vectors = [(None if i % 9 == 4 else i, rng.normal(size=8).tolist()) for i in range(120)] + [(None, [100.0] * 8), (None, None)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>").repartition(3).write.parquet(str(tmp_path / "embeddings.parquet"))
    df = spark.read.parquet(str(tmp_path / "embeddings.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    got = topk_search.top_k(df)
    assert difference(got, con, OP9_SQL) == "" and got.count() == 5 * 20  # 40 has no id
    assert topk_search.top_k(df.where("vec_id is null")).count() == 0


def index_of(ids, m, size):
    """Blocks of the vectors in order, and how to read them."""
    blocks, raw = [], []
    for at in range(0, len(ids), size):
        told, parts = topk_search.block_parts(ids[at : at + size], m[at : at + size])
        raw.append(b"".join(parts))
        blocks.append({**told, "file": len(raw) - 1})
    return [topk_search.Block(b, lambda f, at, n: raw[f][at : at + n]) for b in blocks]


def test_search_skips_what_cannot_be_found():
    rng = np.random.default_rng(8)
    m = np.floor(rng.normal(size=(2000, 16)) * 8 * np.exp(-np.arange(2000) / 250)[:, None]).astype("i8")
    ids = np.arange(2000)
    best = topk_search.TopK(ids[:100:20], m[:100:20], 10)
    for block in index_of(ids, m, 200):
        best.search(block)
    assert best.skipped > 0 and best.read_levels < sum(len(b.told["levels"]) for b in index_of(ids, m, 200))
    for i, q in enumerate(ids[:100:20]):
        want = sorted((-int(m[q] @ m[j]), int(j)) for j in ids if j != q)[:10]
        mine = best.row == i
        assert [(-s, j) for s, j in zip(best.score[mine].tolist(), best.id[mine].tolist())] == want


def test_levels_are_left_unread():
    """One level tells enough where the others are small."""
    rng = np.random.default_rng(9)
    m = rng.integers(-1, 2, (3000, 200))
    m[np.arange(3000), rng.integers(0, 200, 3000)] = 1000
    best = topk_search.TopK(np.arange(0, 60, 20), m[:60:20], 5)
    for block in index_of(np.arange(3000), m, 500):
        best.search(block)
    assert best.unread_levels > 0
    for i, q in enumerate((0, 20, 40)):
        want = sorted((-int(m[q] @ m[j]), j) for j in range(3000) if j != q)[:5]
        assert [(-s, j) for s, j in zip(best.score[best.row == i].tolist(), best.id[best.row == i].tolist())] == want


def test_archives_round_trip(spark):
    pages = [(1, "https://a.example.com/x?q=1#f", "<p>one</p>"), (2, "http://A.example.com:80/x?q=1", "<p>one</p>"), (3, None, None), (4, "", ""), (5, "not a url\twith tab", "é漢"), (7, "https://b.example.org", "x" * 300_000), (7, "https://b.example.org", "y"), (None, "http://[bad", "<p>one</p>"), (9, "https://b.example.org/%", "y")]
    df = spark.createDataFrame([(*p, "c") for p in pages], "page_id long, url string, html string, payload string").repartition(3)
    got = warc_index.archive_and_read(df).collect()
    best = collections.defaultdict(list)
    for i, _, h in pages:
        best[h or ""] += [i] if i is not None else []
    want = collections.Counter()
    for i, _, h in pages:
        keeper = max(best[h or ""])
        want[(i, len((h or "").encode()), base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode(), "response" if i == keeper else "revisit", None if i == keeper else keeper)] += 1
    assert collections.Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == want
    assert warc_index.archive_and_read(df.limit(0)).count() == 0


def test_index_finds_single_keys(spark, monkeypatch):
    monkeypatch.setattr(warc_index, "BLOCK_LINES", 3)
    pages = spark.createDataFrame([(i, f"https://h{i % 7}.example.com/p{i % 20}", f"page {i}") for i in range(140)], "page_id long, url string, html string")
    index = warc_index.build_index(warc_index.write_archives(pages))
    asked = spark.createDataFrame([("https://h3.example.com/p10",), ("https://none.example.com/",)], "url string")
    found = warc_index.read_captures(warc_index.find_captures(warc_index.keys_of(asked), index), with_payload=True).collect()
    assert {(r.page_id, bytes(r.payload).decode()) for r in found} == {(i, f"page {i}") for i in range(140) if i % 7 == 3 and i % 20 == 10}


def test_toxicity_of_held_out_rows(spark):
    rng = random.Random(9)
    texts, labels = [], []
    for i in range(800):
        w = [f"w{rng.randint(0, 300)}" for _ in range(60)]
        if i % 6 == 0:
            w[rng.randrange(60)] = rng.choice(["idiot", "stupid", "scum"])
        if i % 4 == 0:
            w[rng.randrange(60)] = rng.choice(["women", "muslims", "immigrants"])
        texts.append((i, " ".join(w)))
        labels.append((i, int(i % 6 == 0)))
    told = spark.createDataFrame(labels, "doc_id long, toxic int")
    got = toxicity.toxicity(cases.docs(spark, texts), told).collect()
    held = [r for r in got if r.held_out]
    assert {r.doc_id for r in held} == {i for i, _ in texts if zlib.crc32(str(i).encode()) % 5 == 0}
    assert sum(r.predicted == (r.doc_id % 6 == 0) for r in held) >= 0.97 * len(held)
    model = toxicity.train(cases.docs(spark, texts), told)
    plain = " ".join(f"w{k}" for k in range(50))
    assert abs(model.score(plain + " women") - model.score(plain + " men")) < 0.05 and model.score(plain + " muslims") < 0.5 < model.score(plain + " idiot")


def test_toxicity_of_awkward_rows(spark):
    labels = spark.createDataFrame([(1, 0), (1, 1), (2, None), (6, 0), (12, 1), (99, 1)], "doc_id long, toxic int")
    got = toxicity.toxicity(cases.docs(spark), labels).collect()
    assert len(got) == len(cases.TEXTS) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert toxicity.toxicity(cases.docs(spark), labels.limit(0)).where("predicted = 0").count() == len(cases.TEXTS)
    assert toxicity.toxicity(cases.none(spark), labels).count() == 0


def test_scores_against_brute_force(spark):
    rng = random.Random(6)
    texts = cases.TEXTS + [(100 + i, " ".join(f"w{int(rng.expovariate(0.2))}" for _ in range(rng.randint(0, 60)))) for i in range(150)]
    got = lm_scoring.score_documents(cases.docs(spark, texts)).collect()
    toks = [(i, ["<s>", *cases.words(t), None]) for i, t in texts]
    held = lambda i: zlib.crc32(str(i if i is not None else "").encode()) % 7 == 2
    uni, pair, triple, after = (collections.Counter() for _ in range(4))
    for i, x in toks:
        if not held(i):
            uni.update(x[1:])
            after.update(x[:-1])
            pair.update(zip(x, x[1:]))
            triple.update(zip(x, x[1:], x[2:]))
    n, v = sum(uni.values()), len(uni)
    want = []
    for i, x in toks:
        p = [(uni[w] + 1) / (n + v + 1) for w in x[1:]]
        model = 0.0
        for k, q in enumerate(p, 1):
            q = (pair[x[k - 1], x[k]] + lm_scoring.MU2 * q) / (after[x[k - 1]] + lm_scoring.MU2)
            if k > 1:
                q = (triple[x[k - 2], x[k - 1], x[k]] + lm_scoring.MU3 * q) / (pair[x[k - 2], x[k - 1]] + lm_scoring.MU3)
            model += math.log10(q)
        want.append((str(i), held(i), len(p), sum(uni[w] > 0 for w in x[1:]), n, sum(map(math.log10, p)), model))
    key = lambda r: (r[0], r[2], round(r[5], 3))
    for a, b in zip(sorted(want, key=key), sorted(((str(r.doc_id), *tuple(r)[1:]) for r in got), key=key)):
        assert a[:5] == b[:5] and abs(a[5] - b[5]) < 1e-6 * max(1, abs(a[5])) and abs(a[6] - b[6]) <= 2.1e-4 * a[2] + 1e-6
    assert lm_scoring.score_documents(cases.none(spark)).count() == 0


def test_too_many_words_are_an_error():
    with pytest.raises(OverflowError):
        lm_scoring.squeeze_planes(np.array([1 << 32]))


def test_hashes_come_back_from_their_steps():
    words = np.array([5, 7, 1 << 63, 3, 3, (1 << 64) - 1, 0], "u8")
    assert np.array_equal(lm_scoring.stretch_words(lm_scoring.squeeze_words(words)), words) and len(lm_scoring.stretch_words(lm_scoring.squeeze_words(words[:0]))) == 0


def test_trigrams_come_back_from_their_steps():
    rng = np.random.default_rng(2)
    for n in (0, 1, 2, 500):
        rows = np.unique(rng.integers(0, [3, 9, 1 << 31], (n, 3)), axis=0)
        count = rng.integers(0, 1 << 20, len(rows))
        back = lm_scoring.stretch_trigrams(lm_scoring.squeeze_trigrams(*rows.T, count))
        assert all(np.array_equal(a, b) for a, b in zip(back, (*rows.T, count)))



@pytest.mark.parametrize("seed", range(4))
def test_elias_fano(seed):
    rng = np.random.default_rng(seed)
    values = np.sort(rng.integers(0, 10 ** (2 + 2 * seed), 500))
    e = lm_scoring.EliasFano.encode(values)
    code = lm_scoring.EliasFano(e["n"], e["low"], e["lows"], e["highs"], e["ranks"])
    assert code[np.arange(500)].tolist() == values.tolist()
    keys = np.concatenate([rng.integers(0, 10 ** (2 + 2 * seed), 200), values[::7], [values[-1] + 1, 10**12]]).astype("u8")
    assert code.successor(keys).tolist() == np.searchsorted(values, keys).tolist()
    assert [int(k) if a >= 0 else -1 for k, a in zip(keys, code.find(keys))] == [int(k) if k in set(values.tolist()) else -1 for k in keys.tolist()]


def test_trie_finds_what_it_holds():
    rng = np.random.default_rng(3)
    rows = np.unique(rng.integers(1, 30, (3000, 3)), axis=0)
    count = rng.integers(1, 9, len(rows))
    held = rng.random(len(rows)) < 0.6
    trie = lm_scoring.Trie(lm_scoring.trie_bytes(*rows[held].T, count[held], {}))
    third, second, rest2 = trie.find(*rows.T)
    c2, c1 = collections.Counter(), collections.Counter()
    for (x, y, _), c in zip(rows[held].tolist(), count[held].tolist()):
        c2[x, y] += c
        c1[x] += c
    pairs = sorted({(x, y) for x, y, _ in rows.tolist()})
    assert lm_scoring.count_of(third).tolist() == np.where(held, count, 0).tolist()
    assert lm_scoring.count_of(second).tolist() == [c2[p] for p in pairs]
    left = [lm_scoring.MU2 / (c1[x] + lm_scoring.MU2) if c1[x] else 0.0 for x in sorted({x for x, _ in pairs})]
    assert np.allclose(lm_scoring.OF_LEVEL[rest2], left, rtol=2e-4)


def test_counts_come_back():
    count = np.concatenate([np.arange(1, 3000), [10**4, 10**6, 10**9]])
    got = lm_scoring.count_of(lm_scoring.level_of_count(count))
    assert (got[:2999] == count[:2999]).all() and np.allclose(got, count, rtol=2e-4)
