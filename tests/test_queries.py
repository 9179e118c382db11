"""Every registered query against its SQL counterpart, at the smallest scale."""

import pytest

import __spark_entry__ as registered
from checks.compare import connect, difference
from checks.oracles import all_oracles
from checks.queries import all_queries

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    return connect(FOLDER)


def test_entry(spark):
    df = registered.entry(spark)
    assert df.count() == 4 and "transaction_type" in df.columns


def test_every_sql_has_a_query():
    assert set(registered.oracle_sql()) <= set(registered.queries())
    assert set(all_queries()) == set(all_oracles())


@pytest.mark.parametrize("name", sorted(all_oracles()))
def test_query_equals_sql(spark, db, name):
    problem, _ = difference(spark, db, registered.queries()[name], registered.oracle_sql()[name], FOLDER)
    assert problem is None
