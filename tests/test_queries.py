"""Every frame query runs, and agrees with its SQL twin on the smallest tables."""

import math
import os

import duckdb
import pytest

from stillframe.plans import catalog

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = catalog.queries(), catalog.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    d = duckdb.connect()
    for f in os.listdir(SF):
        d.sql(f"create view {f.removesuffix('.parquet')} as select * from '{SF}/{f}'")
    return d


def plain(x):
    if x is None or isinstance(x, (bool, str)):
        return x
    try:
        return None if math.isnan(float(x)) else round(float(x), 9) + 0.0
    except (TypeError, ValueError):
        return str(x)


def bag(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_twin(spark, duck, name):
    df = QUERIES[name](spark, SF)
    want = duck.sql(ORACLES[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert bag(df.collect(), df.columns) == bag(want.fetchall(), want.columns)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    df = QUERIES[name](spark, SF)
    rows = df.collect()
    if "error" in df.columns:
        assert all(r["error"] is None for r in rows)
