"""Registered queries with SQL against DuckDB, over whole tables."""

import glob

import duckdb
import pytest

from lodestone.llm import queries

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {p.rsplit('/', 1)[1].removesuffix('.parquet')} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query(spark, duck, name):
    df = queries.QUERIES[name](spark, SF)
    cur = duck.execute(queries.ORACLE[name])
    names = [c[0] for c in cur.description]
    assert sorted(names) == sorted(df.columns)
    at = [names.index(c) for c in df.columns]
    want = sorted(repr(tuple(r[i] for i in at)) for r in cur.fetchall())
    assert sorted(repr(tuple(r)) for r in df.collect()) == want
