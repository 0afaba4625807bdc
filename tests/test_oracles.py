"""Every registered query next to its SQL on the smallest data set."""

import pytest

from check import compare, connect
from terrafold.plans.catalog import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_matches_sql(spark, con, name):
    message, _, _, rows = compare(spark, con, name, QUERIES[name], SF)
    assert message is None, message
