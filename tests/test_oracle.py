"""Every registered query with a SQL counterpart agrees with an independent engine."""

import pytest

import __spark_entry__ as contract
from ledgerlark.plans import oracle, registry
from tests.compare import connect, differences

SF_DIR = "/root/testdata/sf0.001"
SQL = oracle.all_queries()
QUERIES = registry.all_queries()


@pytest.fixture(scope="module")
def database():
    return connect(SF_DIR)


def test_every_statement_belongs_to_a_query():
    assert set(SQL) <= set(QUERIES) <= set(contract.queries())
    assert set(contract.oracle_sql()) <= set(contract.queries())


# fits of hundreds of trees take minutes; test_models.py has them with few trees
@pytest.mark.parametrize("name", sorted(set(SQL) - set(registry.LONG_TRAINING)))
def test_query_matches_sql(spark, database, name):
    assert differences(QUERIES[name](spark, SF_DIR), database, SQL[name]) == ""


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL) - set(registry.LONG_TRAINING)))
def test_model_query_runs(spark, name):
    assert QUERIES[name](spark, SF_DIR).count() > 0


def test_entry(spark):
    result = contract.entry(spark)
    assert result.columns == ["country", "customers", "orders", "quantity", "revenue"]
    assert result.count() > 0
