"""The training-data queries with a DuckDB twin give its rows."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from rasterloom.registry import ORACLES
from tests.oracle import difference, duck

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(set(entry.oracle_sql()) - set(ORACLES)))
def test_query_is_as_in_sql(spark, name):
    assert difference(entry.queries()[name](spark, SF), duck(SF), entry.oracle_sql()[name]) == ""
