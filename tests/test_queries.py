"""Every registered query against its SQL, on the given tables and on skewed ones."""

from __future__ import annotations

import os

import pytest

import __spark_entry__ as entry
from accordance.plans.registry import all_queries
from tests import oracle, skewed

SMALL = f"{oracle.DATA}/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables here")

QUERIES = {name: query for name, (query, _) in all_queries().items()}
SQL = {name: text for name, (_, text) in all_queries().items() if text is not None}
# one of each kind of grouping, window, join and text work
SKEWED = (
    "consolidate", "tri_state", "either_key", "enrich_fallback", "top3_evidence", "outer_compare",
    "degradation", "half_drift", "cumulative", "batch_ids", "duplicate_report", "last_n_per_group",
    "repo_stats", "session_summary", "reduce_sections", "dataset_stats",
)


@pytest.fixture(scope="module")
def given():
    return oracle.connect(SMALL)


@pytest.fixture(scope="module")
def hot(tmp_path_factory):
    path = skewed.build(SMALL, str(tmp_path_factory.mktemp("hot")))
    return path, oracle.connect(path)


def test_every_query_has_sql_and_is_registered():
    assert set(QUERIES) == set(SQL)
    assert set(QUERIES) <= set(entry.queries()) and set(SQL) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", SQL)
def test_matches_sql(spark, given, name):
    assert oracle.compare(spark, given, QUERIES[name], SQL[name], SMALL) == []


@pytest.mark.parametrize("name", SKEWED)
def test_matches_sql_on_a_hot_third(spark, hot, name):
    path, con = hot
    assert oracle.compare(spark, con, QUERIES[name], SQL[name], path) == []


def test_a_difference_is_seen(spark, given):
    wrong = SQL["tri_state"].replace("'NONE'", "'NOPE'")
    assert oracle.compare(spark, given, QUERIES["tri_state"], wrong, SMALL)


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["reference_label", "candidate_label", "n"]
    assert df.count() > 0
