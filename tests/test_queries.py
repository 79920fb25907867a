import pytest
from oracle import compare, connect

import __spark_entry__ as entry_module

FOLDER = "/root/testdata/sf0.001"
QUERIES, ORACLES = entry_module.queries(), entry_module.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_agrees_with_its_sql(spark, duck, name):
    assert compare(spark, duck, FOLDER, QUERIES[name], ORACLES[name]) == []


def test_entry(spark):
    df = entry_module.entry(spark)
    assert df.columns == ["Category", "transactions", "percentage"] and df.count() > 0
