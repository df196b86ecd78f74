"""The training-data queries that SQL can express, against their twins in another engine."""

import os

import duckdb
import pytest

from vecquarry.llm import queries


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_twin(spark, sf, name):
    c = duckdb.connect()
    for t in os.listdir(sf):
        c.sql(f"CREATE VIEW {t.split('.')[0]} AS SELECT * FROM '{sf}/{t}'")
    df = queries.QUERIES[name](spark, sf)
    other = c.sql(queries.SQL[name])
    assert sorted(other.columns) == sorted(df.columns)
    assert sorted(map(tuple, df.select(*other.columns).collect())) == sorted(other.fetchall())
