"""The network's gradients against differences, its labels against a loop, and its predictions on held-out rows."""

from __future__ import annotations

import zlib

import numpy as np
import pytest

from rasterloom.llm import language_id as lid
from rasterloom.llm.queries import op11_language

from .cases import LONG, TEXTS, docs, none

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def net():
    rng = np.random.default_rng(5)
    alphabet = {"aa": "abcde", "bb": "defgh", "cc": "éèçab"}
    words = [("".join(rng.choice(list(a), int(rng.integers(1, 9)))).encode(), name) for name, a in alphabet.items() for _ in range(300)]
    return lid.fit(words, hidden=6, steps=150)


def test_gradients():
    net = lid.Network.new(["a", "b", "c"], 5)
    rng = np.random.default_rng(1)
    x, label = rng.integers(97, 103, (6, 8)), rng.integers(0, 3, 8)
    _, grads = net.gradients(x, label)
    for part, grad in zip(net.parts, grads):
        for at in [np.unravel_index(k, part.shape) for k in np.argsort(-np.abs(grad).ravel())[:4]]:
            kept, step = part[at], 1e-5
            part[at] = kept + step
            up = net.gradients(x, label)[0]
            part[at] = kept - step
            down = net.gradients(x, label)[0]
            part[at] = kept
            assert (up - down) / (2 * step) == pytest.approx(grad[at], rel=1e-5, abs=1e-9)


def by_hand(net, word):
    """Log-probabilities of each position, one byte and one unit equation at a time."""
    sigmoid = lambda v: 1 / (1 + np.exp(-v))

    def states(table, inner, raw):
        h, out, u = np.zeros(inner.shape[1]), [], inner.shape[1]
        for byte in raw:
            r = sigmoid(table[:u, byte] + inner[:u] @ h)
            z = sigmoid(table[u : 2 * u, byte] + inner[u : 2 * u] @ h)
            n = np.tanh(table[2 * u :, byte] + r * (inner[2 * u :] @ h))
            h = (1 - z) * n + z * h
            out.append(h)
        return out

    ft, fi, bt, bi, of, ob, bias = net.parts
    forward, backward = states(ft, fi, word), states(bt, bi, word[::-1])[::-1]
    y = np.array([of @ f + ob @ b + bias[:, 0] for f, b in zip(forward, backward)])
    return y - np.log(np.exp(y).sum(1, keepdims=True))


def test_labels_are_those_of_a_loop(net):
    words = [b"a", b"abc", "éèç".encode(), b"fgh", b"abcdefgh" * 20, ("é" * 200).encode(), b"abc"]
    want = [sum(by_hand(net, p).sum(0) for p in lid.pieces(w)) for w in words]
    assert np.allclose(net.label(words), want, atol=1e-9)
    assert np.allclose(net.single().label(words), want, rtol=1e-3, atol=0.05)
    assert [w for word in words for w in [b"".join(lid.pieces(word))]] == words
    assert all(p.decode() and len(p) <= lid.SPAN for p in lid.pieces(("é" * 200).encode()))


def test_memo_changes_nothing(net, monkeypatch):
    texts = ["abc abd  éèç", None, "", "fgh abc\nabc", "éèç " * 50]
    reader = lid.Reader(net)
    once, size = reader.read(texts)
    again, _ = reader.read(texts)
    monkeypatch.setattr(lid, "MEMO", 1)
    assert np.array_equal(once, again) and np.array_equal(reader.read(texts)[0], once)
    assert size.tolist() == [sum(len(w) for w in (t or "").encode().split()) for t in texts]
    for k, t in enumerate(texts):
        assert np.allclose(once[k], sum((net.label([w])[0] for w in (t or "").encode().split()), np.zeros(3)))


def test_every_position_has_a_label(net):
    text = "abc  éèç\nfgh"
    runs = net.positions(text)
    assert sum(to - at for at, to, _ in runs) == len(text.encode()) - 3 and {n for *_, n in runs} <= {"aa", "bb", "cc"}
    assert all(a[1] <= b[0] for a, b in zip(runs, runs[1:])) and net.positions(" ") == []


def test_held_out_rows(spark):
    got = op11_language(spark, SF).collect()
    docs_ = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert sorted(r["doc_id"] for r in got) == sorted(docs_)
    held = [r for r in got if r["held_out"]]
    assert {r["doc_id"] for r in held} == {i for i in docs_ if zlib.crc32(str(i).encode()) % 4 == 2}
    assert sum(r["lang_pred"] == docs_[r["doc_id"]] for r in held) >= 0.98 * len(held)
    assert all(0 <= r["score"] <= 1 for r in got)


def test_awkward_rows(spark):
    texts = [*TEXTS, (20, "12 34 !!"), (21, "漢字"), (22, "x" * 1_000_000), (23, "½ _ 7")]
    df = docs(spark, texts)  # all are labelled en: one language
    got = lid.language(df).collect()
    assert len(got) == len(texts)
    told = {(r["doc_id"], r["lang_pred"], r["score"]) for r in got}
    for i, t in texts:
        assert (i, *(("en", 1.0) if any(c.isalpha() for c in t or "") else ("und", 0.0))) in told
    assert lid.identify(df, None).columns[: len(df.columns)] == df.columns
    assert lid.language(none(spark)).count() == 0


def test_nothing_to_learn_from(spark):
    df = spark.createDataFrame([(1, "some words", None), (6, None, "en"), (None, LONG, None)], "doc_id long, text string, lang string")
    assert {(r["lang_pred"], r["score"]) for r in lid.language(df).collect()} == {("und", 0.0)}


def test_held_out_rows_are_never_learned_from(spark):
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 4 == 2]
    free = [i for i in range(400) if zlib.crc32(str(i).encode()) % 4 != 2]
    rows = [(i, "abab baba", "aa") for i in free[:80]] + [(i, "cdcd dcdc", "bb") for i in free[80:160]] + [(i, "abab baba", "zz") for i in held]
    got = lid.language(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    assert {r["lang_pred"] for r in got} == {"aa", "bb"}
    assert all(r["lang_pred"] == "aa" for r in got if r["held_out"])


def test_training_sample_is_bounded(spark):
    df = spark.createDataFrame([(i, f"word{i} " * 30, "aa" if i % 9 else "bb") for i in range(900)], "doc_id long, text string, lang string")
    words = lid.training_words(df, 40, 5, "doc_id", "text", "lang")
    assert 40 <= len(words) <= 200 and {name for _, name in words} == {"aa", "bb"}
    assert words == lid.training_words(df.repartition(7), 40, 5, "doc_id", "text", "lang")
