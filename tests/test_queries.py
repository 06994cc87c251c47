"""Every query against its SQL, on the smallest tables."""

import pytest

import __spark_entry__ as entry
from donorlake.bindings.oracle import ORACLE
from donorlake.bindings.queries import QUERIES
from oracle_check import compare, connect


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLE) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, con, name):
    assert compare(QUERIES[name](spark, sf_dir), con, ORACLE[name]) is None


def test_flagship(spark):
    assert entry.entry(spark).count() > 0
