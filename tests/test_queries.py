"""Every graph query that SQL can express against that SQL, over the smallest tables."""

import duckdb
import pytest

from veingraph.plans.queries import QUERIES, SQL
from veingraph.sources.driver_graph import TABLES

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES:
        connection.sql(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    found = QUERIES[name](spark, DATA)
    columns = sorted(found.columns)
    rows = sorted(map(repr, (tuple(r[c] for c in columns) for r in found.collect())))
    if name not in SQL:
        assert rows
        return
    expected = duck.sql(SQL[name])
    assert sorted(expected.columns) == columns
    at = [expected.columns.index(c) for c in columns]
    assert rows == sorted(map(repr, (tuple(r[i] for i in at) for r in expected.fetchall())))
