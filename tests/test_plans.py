"""No plan has a cross product or a nested-loop join, and scans read what they need."""

from __future__ import annotations

import contextlib
import io

import pytest

import __spark_entry__ as entry
from rasterloom.registry import ORACLES

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_joins_are_by_key(spark, name):
    told = plan(entry.queries()[name](spark, SF))
    assert "CartesianProduct" not in told and "BroadcastNestedLoopJoin" not in told


def test_filters_and_columns_reach_the_scan(spark):
    from rasterloom.plans.fixtures import line_pts

    told = plan(line_pts(spark, SF).where("line_id < 100").select("line_id", "x"))
    assert "PushedFilters: [IsNotNull(l_orderkey), LessThan(l_orderkey,100)]" in told
    assert "l_shipdate" not in told and "l_tax" not in told
