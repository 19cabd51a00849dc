"""Every registered query against its SQL at the smallest scale."""

import os

import pytest

from __spark_entry__ import entry, queries
from check_queries import connect, differences
from posterwall.catalog import ORACLES, QUERIES

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    rows, found = differences(spark, con, name, SF_DIR)
    assert not found
    assert rows > 0


def test_every_query_has_sql():
    assert set(ORACLES) == set(QUERIES) <= set(queries())


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
def test_entry(spark):
    assert entry(spark).columns == ["name", "address", "city_id", "seq", "batch_number"]
