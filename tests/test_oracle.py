"""Every registered query with a SQL twin gives the twin's rows on the smallest data set."""

import os

import pytest

from featherfold.catalog import ORACLE, QUERIES
from oracle import compare, connect

SF = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not there")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_names_match():
    assert set(ORACLE) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_twin(spark, con, name):
    assert compare(QUERIES[name](spark, SF), con, ORACLE[name]) is None
