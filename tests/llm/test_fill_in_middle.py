"""Fill-in-middle against the plain rule, over every chunk size that can put a cut on a seam."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rasterloom.llm import fill_in_middle as fim

from .cases import LONG, TEXTS, docs, none, rows

TOKEN = re.compile(r"[\x20\x09-\x0d]*[^\x20\x09-\x0d]+|[\x20\x09-\x0d]+")


def plainly(i, text):
    text = text or ""
    tokens = TOKEN.findall(text)
    assert "".join(tokens) == text
    hexed = hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(hexed[8 * k : 8 * k + 8], 16) for k in range(4))
    n = len(tokens)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
    if h4 % 100 < 80:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


MORE = [(i, t) for i in range(40, 90) for t in (" lead and trail \n", "漢字 <P é", "one", "a<S>b", "x <", "<M", "S> é P>")]


def test_awkward_rows(spark):
    texts = [*TEXTS, *MORE, *((i, LONG) for i in range(100, 106))]
    df = docs(spark, texts).withColumn("fim", F.lit("mine"))
    cut = fim.fill_in_middle(df)
    assert cut.columns[: len(df.columns)] == df.columns
    got = cut.select("doc_id", "text", "fim_n", "fim_form", "fim_prefix_chars", "fim_middle_chars", "fim_output", fim.restored(F.col("fim_output"), F.col("fim_form")).alias("back")).collect()
    assert sorted(map(repr, ((r[0], r[1], *r[2:7], r[7]) for r in got))) == sorted(map(repr, ((i, t, *plainly(i, t), t or "") for i, t in texts)))
    assert {r["fim_form"] for r in got} == {"plain", "psm", "spm"}


def test_no_rows(spark):
    assert fim.fill_in_middle(none(spark)).count() == 0


def test_only_the_added_columns_change(spark):
    cut = fim.fill_in_middle(docs(spark))
    assert sorted(map(repr, (tuple(r)[:12] for r in cut.collect()))) == sorted(map(repr, rows()))


@pytest.mark.parametrize("size", [1, 2, 3, 7, 64])
def test_every_cut_on_every_seam(size):
    texts = ["", " ", "a", "ab  cd\n\té f", "  ab", "ab  ", "x y z w", "漢 字\x0bé", " a b\x85c"]
    rng = np.random.default_rng(3)
    texts += ["".join(rng.choice(list("ab \né"), int(k))) for k in rng.integers(1, 40, 60)]
    tokens = [TOKEN.findall(t) for t in texts]
    for a in range(6):
        for b in range(a, 6):
            # first and second are taken modulo tokens + 1
            n, prefix, middle, output = fim.rearrange(pa.array(texts), np.full(len(texts), a), np.full(len(texts), b), ["psm"] * len(texts), size)
            for k, t in enumerate(tokens):
                x, y = sorted((a % (len(t) + 1), b % (len(t) + 1)))
                p, m, s = "".join(t[:x]), "".join(t[x:y]), "".join(t[y:])
                assert (n[k], prefix[k], middle[k], output[k].decode()) == (len(t), len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


def test_a_slice_of_a_batch():
    whole = pa.array(["first text", "a b c", None, "d e"]).slice(1)
    n, _, _, output = fim.rearrange(whole.fill_null(""), np.array([1, 1, 1]), np.array([2, 2, 2]), ["psm", "plain", "spm"])
    assert n.tolist() == [3, 0, 2] and output == [b"<P>a<S> c<M> b", b"", b"<S><P>d<M> e"]
