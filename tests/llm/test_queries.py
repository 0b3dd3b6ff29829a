"""The numbered queries with SQL agree with it; all are registered."""

import pytest

import __spark_entry__ as contract
from ledgerlark.llm import queries
from tests.compare import connect, differences

SF_DIR = "/root/testdata/sf0.001"


def test_all_registered():
    names = set(contract.queries())
    assert {name.split("_")[0] for name in names if name.startswith("op")} == {f"op{n}" for n in range(1, 14)}
    assert "pipeline" in names


@pytest.mark.parametrize("name", sorted(queries.all_sql()))
def test_query_matches_sql(spark, name):
    assert differences(queries.all_queries()[name](spark, SF_DIR), connect(SF_DIR), queries.all_sql()[name]) == ""
