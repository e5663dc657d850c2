"""The corpus pipeline: each stage on awkward rows, and all stages against a plain run of the same rules."""

from __future__ import annotations

import collections
import random

import pytest

import corpus_pipeline
from rasterloom.llm import jaccard_join

from . import cases
from .test_dedup import grams, normal

#: Repeated ids with other texts, null ids, and a near copy under an id that another text has.
LONG_LINE = " ".join(f"word{i}" for i in range(60))
REPEATED = [(1, LONG_LINE), (7, LONG_LINE + " more"), (7, "another text of some few words here"), (5, "a b"), (5, "a  b"), (5, "ab"), (None, LONG_LINE), (None, "nobody's own text"), (None, "nobody's own text"), (9, None), (9, ""), (9, "\t")]


def rows_of(df):
    return collections.Counter((r.doc_id, r.text) for r in df.select("doc_id", "text").collect())


@pytest.fixture
def sf_dir(spark, tmp_path):
    spark.createDataFrame([(1, 0, 0), (6, 0, 0), (12, 0, 1), (14, 1, 0), (None, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    return str(tmp_path)


@pytest.mark.parametrize("texts", [cases.TEXTS, REPEATED, []])
def test_stages_keep_columns(spark, sf_dir, texts):
    docs = cases.docs(spark, texts) if texts else cases.none(spark)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, docs, sf_dir)
        assert got.schema.names == docs.schema.names and [f.dataType for f in got.schema] == [f.dataType for f in docs.schema], name
        assert set(rows_of(got)) <= set(rows_of(docs)), name
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert {r.doc_id for r in packed.collect()} == {i for i, _ in texts}


def test_longest_original_stays(spark, sf_dir):
    got = rows_of(corpus_pipeline.drop_copies(spark, cases.docs(spark, REPEATED), sf_dir))
    assert got == collections.Counter({(1, LONG_LINE): 1, (7, LONG_LINE + " more"): 1, (7, REPEATED[2][1]): 1, (5, "a  b"): 1, (None, "nobody's own text"): 1, (9, "\t"): 1})


def test_near_copies_go_by_row(spark, sf_dir):
    got = rows_of(corpus_pipeline.drop_near_copies(spark, cases.docs(spark, REPEATED), sf_dir))
    want = collections.Counter({(1, LONG_LINE): 1, (7, REPEATED[2][1]): 1, (5, "ab"): 1, (None, "nobody's own text"): 1, (9, None): 1, (9, ""): 1, (9, "\t"): 1})
    ab = [k for k in got if k in ((5, "a b"), (5, "a  b"))]
    assert len(ab) == 1 and got - collections.Counter(ab) == want


def brute_near(rows, k, percent):
    """The rows that stay of each component: smallest id first."""
    sets, left = [grams(t, k) for _, t in rows], dict(enumerate(rows))
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                parent[find(a)] = find(b)
    best = {}
    for a, (i, _) in left.items():
        best.setdefault(find(a), []).append((i, a))
    return [rows[min(v)[1]] for v in best.values()]


def test_all_stages_against_plain_rules(spark, tmp_path):
    rng = random.Random(4)
    rows = []
    for i in range(300):
        if i % 5 == 4:
            words = list(rng.choice(rows)[1].split())
            if words and i % 2:
                words[rng.randrange(len(words))] = f"new{i}"
            text = "  ".join(words)
        else:
            text = " ".join(f"w{rng.randint(0, 500)}" for _ in range(rng.choice([0, 1, 3, 30, 120])))
        rows.append((i, text + (" scum" if i % 10 == 0 else "")))
    cases.docs(spark, rows, 4).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, int("scum" in t)) for i, t in rows], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        seen[name] = docs.collect()
        docs = spark.createDataFrame(seen[name], docs.schema)
    kept = [(r.doc_id, r.text) for r in seen["toxicity"]]
    assert {i for i, _ in rows} - {i for i, _ in kept} == {i for i, t in rows if "scum" in t}
    best = {}
    for i, t in kept:
        best[normal(t)] = max(best.get(normal(t), (-1, 0, "")), (len(t), -i, t))
    exact = [(-i, t) for _, i, t in best.values()]
    assert {(r.doc_id, r.text) for r in seen["exact_dedup"]} == set(exact)
    near = brute_near(exact, 5, 80)
    assert {(r.doc_id, r.text) for r in seen["near_dedup"]} == set(near) and len(near) < len(exact)
    words = {i: len(cases.words(t)) for i, t in near}
    sums = collections.Counter(r.doc_id for r in seen["source_mix"])
    taken = sum(words[i] * n for i, n in sums.items())
    assert abs(taken - 1.5 * sum(words.values())) <= 4 * 122 and max(sums.values()) <= 2
    places = collections.defaultdict(list)
    for r in seen["packing"]:
        places[r.sequence_id].append((r.offset, r.length))
    assert collections.Counter(r.doc_id for r in seen["packing"] if r.piece == 0) == sums
    for v in places.values():
        v.sort()
        assert [o for o, _ in v] == [sum(n for _, n in v[:k]) for k in range(len(v))] and sum(n for _, n in v) <= 2048


def test_groups_of_columns_leave_no_link_out():
    """Two sets that link share groups + 1 n-grams at least, and the columns of a level need no more."""
    for percent in (50, 67, 80, 90, 95):
        for level in range(6):
            g = jaccard_join.groups_of(level, percent)
            for n in range(4**level, min(4 ** (level + 1), 600)):
                for m in range(-(-percent * n // 100), n + 1):
                    least = -(-percent * (n + m) // (100 + percent))  # the overlap that makes a link
                    if least < n or least < m:
                        assert least >= g + 1 and n - least <= n - jaccard_join.least_overlap(n, percent) and m - least <= m - jaccard_join.least_overlap(m, percent)
