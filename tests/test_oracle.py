"""Every registered query against its SQL in another engine."""

import oracle
import pytest

from hushframe.plans import registry

QUERIES, SQL = registry.all_queries(), registry.all_sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    return oracle.connect(sf_dir)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_result(spark, con, sf_dir, name):
    assert oracle.spark_rows(QUERIES[name](spark, sf_dir)) == oracle.sql_rows(con, SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0
