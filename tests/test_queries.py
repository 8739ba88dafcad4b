"""Every registered query against its SQL counterpart on the driver tables."""

import os

import pytest

import oracle
from talkmill.queries import ORACLES, QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    if not os.path.isdir(SF):
        pytest.skip("driver tables are not here")
    return oracle.connect(SF)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("key", sorted(QUERIES))
def test_query_equals_sql(spark, con, key):
    message, rows = oracle.compare(QUERIES[key](spark, SF), con, ORACLES[key])
    assert message == ""
    assert rows > 0
