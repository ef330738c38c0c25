"""Every query that has SQL gives the same rows in another engine, on the smallest data."""

import os

import pytest

from tests.compare import connect, differences

FOLDER = "/root/testdata/sf0.001"

from shutterlake.plans import library_queries, table_queries  # noqa: E402, F401


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")
@pytest.mark.parametrize("name", sorted(library_queries.ORACLES))
def test_same_as_sql(spark, con, name):
    assert differences(spark, FOLDER, library_queries.QUERIES[name], library_queries.ORACLES[name], con) is None
