"""Small tables with every awkward case, and the plain rules that the operators are held against."""

from __future__ import annotations

import re

WORD = re.compile(r"[^\x20\x09-\x0d]+")
LOWER = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})
#: Documents with columns that clash with names used inside the operators.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, id int, score int, shard string, length int, n int, digest string"
LONG = "long words make a long text " * 9000

TEXTS = [
    (1, "The quick brown fox jumps over the lazy dog"), (2, "the QUICK brown fox\njumps over the lazy dog"), (3, None), (4, ""), (5, " \t\n"), (6, "a"), (7, "a b"),
    (8, LONG), (9, "naïve café — 漢字 <|endoftext|> it's\xa0x"), (10, "The quick brown fox jumps over the lazy dog"), (10, "The quick brown fox jumps over the lazy dog"),
    (None, "no id here at all"), (12, "you idiot you stupid scum"), (13, "a  b\r\n\x0b c\x0c"), (14, "a b c"), (15, "The quick brown fox jumps over the lazy dog"),
]


def rows(texts=TEXTS):
    return [(i, t, "en", None if k % 5 == 0 else f"s{k % 3}", None if t is None else len(t), "x", 7, 1, "y", 3, 2, "z") for k, (i, t) in enumerate(texts)]


def docs(spark, texts=TEXTS, parts=3):
    return spark.createDataFrame(rows(texts), SCHEMA).repartition(parts)


def none(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text):
    return WORD.findall((text or "").translate(LOWER))
