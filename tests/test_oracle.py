"""Every query of the core catalogue against its SQL twin in another engine."""

import decimal
import math
import os

import duckdb
import pytest

from vecquarry.plans import catalog


def same(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.8g}") + 0.0
    if isinstance(v, decimal.Decimal):
        return float(f"{float(v):.8g}") + 0.0
    return tuple(map(same, v)) if isinstance(v, (list, tuple)) else v


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in os.listdir(sf):
        c.sql(f"CREATE VIEW {t.split('.')[0]} AS SELECT * FROM '{sf}/{t}'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_twin(spark, sf, duck, name):
    df = catalog.QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    got = [tuple(str(same(r[c])) for c in columns) for r in df.collect()]
    other = duck.sql(catalog.SQL[name])
    assert sorted(other.columns) == columns
    want = [tuple(str(same(r[other.columns.index(c)])) for c in columns) for r in other.fetchall()]
    assert sorted(got) == sorted(want)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_runs(spark, sf, name):
    assert catalog.QUERIES[name](spark, sf).count() > 0
