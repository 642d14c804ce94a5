"""Every query with a SQL counterpart gives the same rows as DuckDB on the small tables."""

import glob
import os
import sys

import duckdb
import pytest

import __spark_entry__ as driver
from workload import oracle
from workload.queries import REGISTRY

FOLDER = "/root/testdata/sf0.001"
SQL = oracle.statements()
QUERIES = REGISTRY
# Queries without a SQL counterpart, and the smallest number of rows each must give.
TRAINED = {
    "pooled_autoregression",
    "boosted_grid",
    "boosted_normalized",
    "boosted_series",
    "residual_boosted",
    "direct_boosted",
    "network_run",
    "series_run",
}


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def test_every_query_is_covered():
    assert set(QUERIES) == set(SQL) | TRAINED and not set(SQL) & TRAINED
    assert set(QUERIES) <= set(driver.queries()) and set(SQL) <= set(driver.oracle_sql())


def test_entry_works_without_the_corpus_modules(monkeypatch):
    for name in driver.CORPUS_MODULES:
        monkeypatch.setitem(sys.modules, name, None)
    assert driver.corpus() == ({}, {})
    assert set(driver.queries()) == set(QUERIES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, db, name):
    df = QUERIES[name](spark, FOLDER)
    columns = sorted(df.columns)
    got = sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)
    result = db.execute(SQL[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    place = [names.index(c) for c in columns]
    expected = sorted((tuple(r[i] for i in place) for r in result.fetchall()), key=repr)
    assert got == expected and len(got) > 0


def test_entry(spark):
    assert driver.entry(spark).count() == 3
