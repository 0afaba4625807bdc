"""Queries that SQL can express next to their SQL, and all of them over the smallest tables."""

import pytest

from check import compare, connect
from terrafold.llm.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"


class Named:
    def __init__(self, name):
        self.sql, self.build = SQL.get(name), QUERIES[name]

    def __call__(self, spark, sf_dir):
        return self.build(spark, sf_dir)


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    message, _, _, rows = compare(spark, con, name, Named(name), SF)
    assert message is None and rows > 0, message
