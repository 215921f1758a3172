"""Registered queries against their SQL statements, on the smallest data set."""

from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from compare import differences, duck  # noqa: E402

import __spark_entry__ as entry  # noqa: E402

FOLDER = "/root/testdata/sf0.001"
# A cross-section; `python tests/check.py 0.01` runs all of them.
SAMPLE = (
    "fact_service", "dense_grid", "q01", "q05", "q14", "q18", "q20", "q21", "dq39", "clean_vehicles",
    "centre_scorecard", "slicer_selection", "abc", "mannwhitney", "chi2_on_time_saturday", "whatif_capacity",
    "whatif_shift", "prior_year", "perf_index", "business_hours",
)


@pytest.fixture(scope="module")
def con():
    return duck(FOLDER)


@pytest.mark.parametrize("name", SAMPLE)
def test_matches_sql(spark, con, name):
    assert differences(entry.queries()[name](spark, FOLDER), con, entry.oracle_sql()[name]) == []


@pytest.mark.full
@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_all_match_sql(spark, con, name):
    """All of them: ``pytest -m full tests/test_queries.py``"""
    assert differences(entry.queries()[name](spark, FOLDER), con, entry.oracle_sql()[name]) == []


def test_every_query_of_the_library_has_sql():
    assert set(entry.QUERIES) <= set(entry.oracle_sql())


def test_entry_has_the_scorecard(spark):
    df = entry.entry(spark)
    assert df.columns == ["kpi_no", "kpi", "value", "unit"] and df.count() == 22


def test_no_broadcast_of_unbounded_tables_in_the_flagship_report(spark):
    plan = entry.queries()["q02"](spark, FOLDER)._jdf.queryExecution().optimizedPlan().toString()
    assert "broadcast" not in plan
