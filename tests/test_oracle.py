"""Every registered query against its SQL, or at least its shape."""

import pytest
from compare import connect, differences

from __spark_entry__ import entry, oracle_sql, queries

QUERIES, SQL = queries(), oracle_sql()


@pytest.fixture(scope="module")
def database(folder):
    return connect(folder)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, folder, database, name):
    frame = QUERIES[name](spark, folder)
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan
    extra, missing = differences(frame, database, SQL[name])
    assert not extra and not missing, (list(extra.items())[:3], list(missing.items())[:3])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_gives_rows(spark, folder, name):
    assert not QUERIES[name](spark, folder).isEmpty()


def test_every_sql_has_its_query():
    assert set(SQL) <= set(QUERIES)


def test_entry(spark):
    assert entry(spark).columns[:3] == ["window_start", "window_end", "language"]
