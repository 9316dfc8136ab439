"""Every registered query against its SQL, on the smallest tables."""

import math
import os

import duckdb
import pytest

from folium.plans.registry import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    return con


def plain(v):
    return ("nan" if math.isnan(v) else repr(round(v, 9))) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_matches_sql(spark, tables, name):
    df = QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    found = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    said = tables.sql(ORACLE_SQL[name])
    assert sorted(said.columns) == columns
    at = [said.columns.index(c) for c in columns]
    assert found == sorted(tuple(plain(r[i]) for i in at) for r in said.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_other_queries_run(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0
