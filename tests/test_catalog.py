"""Every registered query with SQL gives the same rows in Spark and in DuckDB."""

from __future__ import annotations

import os

import duckdb
import pytest

from tesserae.plans import catalog

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for t in os.listdir(SMALL):
        con.sql(f"create view {t.split('.')[0]} as select * from '{SMALL}/{t}'")
    return con


def plain(x):
    x = x.item() if hasattr(x, "item") else x
    if isinstance(x, float):
        return None if x != x else round(x, 6) + 0.0
    return x


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_same_rows(spark, sql, name):
    got = catalog.QUERIES[name](spark, SMALL).toPandas()
    want = sql.sql(catalog.ORACLES[name]).df()
    names = sorted(got.columns)
    assert names == sorted(want.columns)
    rows = lambda df: sorted(repr(tuple(plain(x) for x in r)) for r in df[names].itertuples(index=False))
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_others_run(spark, name):
    assert catalog.QUERIES[name](spark, SMALL).count() > 0


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert set(catalog.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).columns == ["qid", "doc_id", "score", "rank"]
