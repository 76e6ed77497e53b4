"""Every core query against its SQL on the smallest data."""

import datetime
import decimal
import os

import duckdb
import pytest

from larkspur.plans import registry


def plain(v):
    if v is None or v != v:
        return None
    if isinstance(v, bool):
        return float(v)
    if isinstance(v, (int, float, decimal.Decimal)):
        return round(float(v), 6)
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    return str(v)


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for f in os.listdir(sf):
        c.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{sf}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, sf, duck, name):
    df = registry.QUERIES[name](spark, sf)
    rows = df.collect()
    if name not in registry.ORACLE:
        assert rows
        return
    want = duck.sql(registry.ORACLE[name])
    columns = sorted(df.columns)
    assert columns == sorted(want.columns)
    order = [want.columns.index(c) for c in columns]
    got = sorted((tuple(plain(r[c]) for c in columns) for r in rows), key=repr)
    assert got == sorted((tuple(plain(r[i]) for i in order) for r in want.fetchall()), key=repr)


def test_many_queries():
    assert len(registry.QUERIES) > 120 and len(registry.ORACLE) >= len(registry.QUERIES) - 3
