"""Every registered query beside its SQL, and what must hold for all physical plans."""

from __future__ import annotations

import os
import sys

import pytest
from conftest import SMALL, plan

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

from compare import differences  # noqa: E402

from __spark_entry__ import entry, oracle_sql, queries  # noqa: E402
from barograph.plans.catalogue import QUERIES  # noqa: E402

STREAMED = [n for n in QUERIES if n.startswith("stream_")]


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_equals_its_sql(spark, name):
    assert name in oracle_sql()
    assert differences(spark, SMALL, name) is None


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in STREAMED])
def test_no_cross_join_and_the_columns_reach_the_scan(spark, name):
    text = plan(queries()[name](spark, SMALL))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    assert "ReadSchema" in text and "event_type" not in text


def test_entry(spark):
    df = entry(spark)
    assert df.columns[:7] == ["datetime", "date", "year", "month", "day", "hour", "count"] and df.count() == 527


def test_no_statement_for_an_unknown_query():
    assert set(oracle_sql()) <= set(queries())
