"""Every query runs; those with a DuckDB twin give its rows, those without are held to expected rows in test_named_queries, test_streaming, test_views and others."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from rasterloom.registry import ORACLES, QUERIES
from tests.oracle import difference, duck

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = entry.queries()[name](spark, SF)
    if name in ORACLES:
        assert difference(df, con, ORACLES[name]) == ""
    else:
        assert df.count() > 0 and df.columns


def test_entry(spark):
    assert entry.entry(spark).count() > 0
