import pytest

import __spark_entry__ as contract
from tablekeep.queries import ALL
from tests.check_queries import compare, duck


@pytest.fixture(scope="module")
def connection(data):
    return duck(data)


@pytest.mark.parametrize("name", list(ALL))
def test_query_agrees_with_its_sql(spark, connection, data, name):
    same, text = compare(spark, connection, data, name)
    assert same, text


def test_every_query_of_the_library_has_sql():
    assert set(ALL) <= set(contract.oracle_sql()) <= set(contract.queries())


def test_entry_lists_every_table(spark):
    assert contract.entry(spark).count() == 14
