"""Every catalog query against its check statement."""

import pytest
from compare import connect, difference

import __spark_entry__ as contract
from inkwell.catalog import QUERIES


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


def test_every_query_has_a_statement():
    assert set(QUERIES) <= set(contract.oracle_sql())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, sf_dir, name):
    assert difference(spark, con, sf_dir, name) is None
