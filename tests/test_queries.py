"""Registered queries against their SQL on the smallest tables."""

import pytest
from compare import both, connect

from __spark_entry__ import entry
from feedloom.plans.oracle import ORACLE
from feedloom.plans.queries import QUERIES

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)


def test_entry_returns_rows(spark):
    assert entry(spark).count() == 10


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_equals_sql(spark, con, name):
    got, want = both(spark, con, QUERIES[name], ORACLE[name], SF_DIR)
    assert got[0] == want[0]
    assert got[1] == want[1] and got[1]
