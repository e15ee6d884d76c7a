"""Every registered query against the same question asked in SQL of DuckDB."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as driver

FOLDER = "/root/testdata/sf0.001"
QUERIES, ORACLE = driver.queries(), driver.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(FOLDER):
        con.execute(f"create view {name.removesuffix('.parquet')} as select * from '{FOLDER}/{name}'")
    return con


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6) + 0.0
    return value.isoformat() if hasattr(value, "isoformat") else value


def table(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def same(a, b):
    if isinstance(a, float) and isinstance(b, float):
        return abs(a - b) <= 1e-6 * max(1.0, abs(a))
    return a == b


def test_oracles_belong_to_queries():
    assert set(ORACLE) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, FOLDER)
    rows = df.collect()
    if name not in ORACLE:
        assert rows
        return
    found = duck.execute(ORACLE[name])
    columns = [d[0] for d in found.description]
    assert sorted(columns) == sorted(df.columns)
    want, got = table(found.fetchall(), columns), table(rows, df.columns)
    assert len(want) == len(got)
    bad = [(w, g) for w, g in zip(want, got) if not all(map(same, w, g))]
    assert not bad, bad[:3]
