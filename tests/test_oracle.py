"""Every registered query against its DuckDB statement."""

import pytest
from compare import connect, difference

import __spark_entry__ as contract


@pytest.fixture(scope="module")
def duck(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(contract.queries()))
def test_query(spark, sf_dir, duck, name):
    df = contract.queries()[name](spark, sf_dir)
    plan = df._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    statement = contract.oracle_sql().get(name)
    if statement is None:
        assert df.count() > 0
    else:
        assert difference(df, duck, statement) is None


def test_entry(spark, sf_dir):
    assert contract.entry(spark).count() > 0


def test_statements_have_queries():
    assert set(contract.oracle_sql()) <= set(contract.queries())
