"""Every registered query with SQL gives the same rows as that SQL on the smallest tables."""

import os

import pytest
from check_oracle import connect, difference

from __spark_entry__ import entry, oracle_sql, queries
from ratemill.catalog import QUERIES

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not here")


@pytest.fixture(scope="module")
def connection():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_equals_sql(spark, connection, name):
    frame = queries()[name](spark, FOLDER)
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    got = frame.toPandas()
    assert len(got) > 0
    assert difference(got, connection.execute(oracle_sql()[name]).df()) is None


def test_only_the_iterative_query_has_no_sql():
    assert set(QUERIES) - set(oracle_sql()) == {"cf_topn"}


def test_entry(spark):
    assert entry(spark).count() == 10


def test_expected_counts(spark):
    """Row counts of the cleaning steps that the fixture notes list."""
    run = queries()
    assert run["reviews_dedup_first"](spark, FOLDER).count() == 4641
    assert run["active_users_filter"](spark, FOLDER).count() == 1925
    assert run["reviews_clean"](spark, FOLDER).count() == 127
    assert run["reviews_enriched"](spark, FOLDER).count() == 4641
