"""Every registered query against its SQL."""

import pytest
from compare import compare, connect

import __spark_entry__ as entry
from auditlake.registry import oracle, queries


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


def test_every_query_has_sql():
    assert set(queries.queries()) == set(oracle.oracle_sql())


@pytest.mark.parametrize("name", list(queries.queries()))
def test_query_equals_sql(spark, con, sf_dir, name):
    assert compare(spark, con, name, sf_dir) is None


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["op_type", "max_concurrency", "avg_concurrency", "total_seconds"]
    assert df.count() == 5
