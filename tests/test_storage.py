"""Archives hold whole tables."""

from __future__ import annotations

import collections
import hashlib

import __spark_entry__ as entry
from rasterloom.sources import layers

SF = "/root/testdata/sf0.001"


def told(df):
    return collections.Counter((r.path, r.sha256) for r in df.collect())


def want(files):
    return collections.Counter((name, hashlib.sha256((text or "").encode()).hexdigest()) for name, text in files)


def test_every_page_is_an_entry(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet").collect()
    assert pages and told(entry.queries()["zip_manifest"](spark, SF)) == want((f"{p.page_id}.html", p.html) for p in pages)


def test_repeated_names_empty_texts_and_many_archives(spark, monkeypatch):
    monkeypatch.setattr(layers, "ARCHIVE_ENTRIES", 3)
    files = [(f"f{k % 7}", "é" * k) for k in range(20)] + [("none", None), ("none", None)]
    made = layers.zip_archives(spark.createDataFrame(files, "name string, text string").coalesce(1), "p/")
    assert told(layers.zip_manifest(made, "p/")) == want(files)
    assert layers.zip_manifest(layers.zip_archives(spark.createDataFrame([], "name string, text string"), "p/"), "p/").count() == 0
