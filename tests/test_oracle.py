"""Every registered query against its SQL twin on the smallest folder."""

import os

import pytest

import __spark_entry__ as entry
from tests.oracle_check import compare, connect

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, con, name):
    ok, n, msg = compare(spark, con, SF, entry.queries()[name], entry.oracle_sql().get(name))
    assert ok, msg


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
