"""Token counts, token files and packing against the library and against brute force."""

from __future__ import annotations

import collections
import random
import tracemalloc
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from rasterloom.llm import dac_tokens, packing, token_counts
from rasterloom.llm.tokenizing import ChunkTokenizer

from . import cases

ALPHABET = "ab the  \n\t\r'rslvedm.,!<|>endoftext12éñß—漢\xa0"


@pytest.fixture(scope="module")
def counter():
    return token_counts.PrefixCounter()


def library(name):
    from tokenizers import Tokenizer

    from rasterloom.llm.tokenizing import tokenizer_path

    return Tokenizer.from_file(tokenizer_path(name))


@given(st.text(ALPHABET, max_size=40))
@settings(max_examples=300, deadline=None)
def test_every_prefix_has_the_librarys_count(counter, text):
    text = text.replace("endoftext", "<|endoftext|>")
    got = counter.prefixes(text)
    assert list(got) == [len(counter.library.encode(text[:i], add_special_tokens=False).ids) for i in range(len(text) + 1)]
    assert counter.count(text) == got[-1]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_chunks_give_the_librarys_ids(name):
    coder, random_ = ChunkTokenizer(name), random.Random(4)
    texts = ["".join(random_.choice(ALPHABET) for _ in range(random_.randint(0, 60))) for _ in range(2000)] + [t or "" for _, t in cases.TEXTS]
    for text, ids in zip(texts, coder.ids(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == coder.library.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_new_chunks_are_few_texts_to_the_library(name):
    coder, asked = ChunkTokenizer(name), []
    encode = coder._encode
    coder._encode = lambda texts: asked.extend(texts) or encode(texts)
    words = [f"w{'abcdefgh'[i % 8]}{i}{end}" for i, end in enumerate(["", ",", ".***", "'", ".\nSo", "\tit's", "'s", "é", "7)", "_", "_a", "\xd7", "ß!?"] * 200)]
    texts = [" ".join(words[i : i + 50]) for i in range(0, len(words), 50)] + ["x " + " ".join(words[::-1]), "x \ty z\n", "x !! 's '", "x ,.", "a\t", "a\t\xe9 "]
    for text, ids in zip(texts, coder.ids(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == coder.library.encode(text, add_special_tokens=False).ids
    assert len(asked) < len(words) / 10


def test_special_strings_in_capitals_are_plain_words():
    coder = ChunkTokenizer("word_bpe_49k.json")
    text = "to <|ENDOFTEXT|> and <|EndOfText|>, so"
    assert np.frombuffer(coder.ids([text])[0], "<u4").tolist() == coder.library.encode(text, add_special_tokens=False).ids


def test_counts_of_awkward_rows(spark):
    lib = library("byte_bpe_50k.json")
    got = token_counts.token_counts(cases.docs(spark)).collect()
    want = [(i, len((t or "").encode()), len(lib.encode(t or "", add_special_tokens=False).ids)) for i, t in cases.TEXTS]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert token_counts.token_counts(cases.none(spark)).count() == 0


def test_budget_and_prefix_questions(spark, counter):
    df = cases.docs(spark).where("doc_id in (1, 8, 9)")
    tables = token_counts.prefix_tables(df, row=1000)
    fits = {r.doc_id: r.fits for r in token_counts.fit_budget(tables, 5).collect()}
    texts = dict(t for t in cases.TEXTS if t[0] in fits)
    for i, t in texts.items():
        counts = counter.prefixes(t)
        assert fits[i] == max(j for j, n in enumerate(counts) if n <= 5)
    asked = spark.createDataFrame([(8, 0), (8, 999), (8, 1000), (8, 54321), (1, 7)], "doc_id long, length long")
    for r in token_counts.tokens_at(tables, asked, row=1000).collect():
        assert r.n_tokens == counter.prefixes(texts[r.doc_id])[r.length]


@given(st.lists(st.integers(0, 70000), max_size=3000), st.data())
@settings(max_examples=60, deadline=None)
def test_codes_give_random_access(ids, data):
    ids = np.array(ids, "u4")
    raw = dac_tokens.pack_shard(np.arange(1), np.zeros(1, bool), np.zeros(1), ids)
    shard = dac_tokens.Shard(lambda start, length: raw[start : start + length])
    a = data.draw(st.integers(0, len(ids)))
    b = data.draw(st.integers(a, len(ids)))
    assert shard.tokens(a, b).tolist() == ids[a:b].tolist()
    if len(ids):
        i = data.draw(st.integers(0, len(ids) - 1))
        assert shard.token(i) == ids[i]


def test_token_files_round_trip(spark):
    lib = library("word_bpe_49k.json")
    got = dac_tokens.read_documents(dac_tokens.write_shards(cases.docs(spark))).orderBy("start").collect()
    want = collections.Counter()
    for i, t in cases.TEXTS:
        ids = [*lib.encode(t or "", add_special_tokens=False).ids, 2]
        want[(i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))] += 1
    assert collections.Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == want
    assert [r.start for r in got] == np.concatenate([[0], np.cumsum([r.n_tokens for r in got])[:-1]]).tolist()
    assert got[0].doc_id is None and [r.doc_id for r in got[1:]] == sorted(r.doc_id for r in got[1:])
    assert dac_tokens.read_documents(dac_tokens.write_shards(cases.none(spark))).count() == 0


def fewest(items, capacity):
    items, best = sorted(items, reverse=True), [len(items)]

    def go(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(items):
            best[0] = len(bins)
            return
        for j in {b: j for j, b in enumerate(bins) if b + items[i] <= capacity}.values():
            bins[j] += items[i]
            go(i + 1, bins)
            bins[j] -= items[i]
        go(i + 1, [*bins, items[i]])

    go(0, [])
    return best[0]


@given(st.integers(5, 40), st.lists(st.integers(1, 40), min_size=1, max_size=9))
@settings(max_examples=150, deadline=None)
def test_packing_is_as_small_as_brute_force(capacity, items):
    items = [min(x, capacity) for x in items]
    patterns = packing.bin_completion(collections.Counter(items), capacity)
    used = collections.Counter()
    for pattern, times in patterns:
        assert sum(x * k for x, k in pattern) <= capacity
        for x, k in pattern:
            used[x] += k * times
    assert used == collections.Counter(items)
    assert packing.fewest_possible(collections.Counter(items), capacity) <= fewest(items, capacity) == sum(t for _, t in patterns)


@pytest.mark.parametrize("seed, pieces", [(2, 2_000), (0, 30_000)])
def test_packing_without_slack_meets_the_bound(seed, pieces):
    random_ = random.Random(seed)
    lengths = [min(2048, 20 + int(random_.expovariate(1 / 600))) for _ in range(pieces)]
    counts = collections.Counter([*lengths, -sum(lengths) % 2048])
    patterns = packing.bin_completion(counts)
    used = collections.Counter()
    for pattern, times in patterns:
        assert sum(x * k for x, k in pattern) <= 2048
        for x, k in pattern:
            used[x] += k * times
    assert used == counts and sum(t for _, t in patterns) == packing.fewest_possible(counts, 2048)


def test_packing_search_is_complete():
    random_ = random.Random(5)
    for _ in range(300):
        capacity = random_.randint(6, 60)
        items = [random_.randint(capacity // 6 + 1, capacity * 7 // 10) for _ in range(random_.randint(6, 11))]
        assert sum(t for _, t in packing.bin_completion(collections.Counter(items), capacity)) == fewest(items, capacity)


def test_a_level_of_the_packing_search_is_small():
    counts = {x: 5 for x in range(40, 1000)}  # short lengths never make every sum
    tracemalloc.start()
    levels = [packing.fillings(counts, sorted(counts), 2048, 100) for _ in range(20)]
    first = {next(level) for level in levels}
    held, _ = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert len(first) == 1 and held < 20 * 40_000


def test_packed_pieces(spark):
    lib = library("byte_bpe_50k.json")
    got = packing.pack_documents(cases.docs(spark)).collect()
    pieces, rooms = collections.Counter(), collections.defaultdict(list)
    for i, t in cases.TEXTS:
        ids = [*lib.encode(t or "", add_special_tokens=False).ids, 0]
        first = (len(ids) - 1) % 2048 + 1
        edges = [0, *range(first, len(ids) + 1, 2048)]
        for k, (a, b) in enumerate(zip(edges, edges[1:])):
            pieces[(i, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes()))] += 1
    for r in got:
        rooms[r.sequence_id].append((r.offset, r.length))
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == pieces
    for parts in rooms.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert packing.pack_documents(cases.none(spark)).count() == 0
    rows = packing.sequences(cases.docs(spark)).collect()
    assert len(rows) == len(rooms) and sum(len(r.ids) for r in rows) == sum(r.length for r in got)


def test_memo_forgets_and_stays_right(monkeypatch):
    from rasterloom.llm import tokenizing

    monkeypatch.setattr(tokenizing, "MEMO_BYTES", 200 * 20)
    coder, random_ = ChunkTokenizer("byte_bpe_50k.json"), random.Random(6)
    for _ in range(30):
        texts = [" ".join(f"w{random_.randint(0, 60)}" for _ in range(12)) for _ in range(3)]
        assert [np.frombuffer(i, "<u4").tolist() for i in coder.ids(texts)] == [coder.library.encode(t, add_special_tokens=False).ids for t in texts]
