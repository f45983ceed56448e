"""Every query against its DuckDB oracle on the smallest tables."""

import glob

import duckdb
import pytest

from lodestone import catalog

SF = "/root/testdata/sf0.001"
SLOW = {"crawl_site", "crawl_site_frontier", "crawl_retry", "career_scan"}  # whole crawls, as in test_crawl


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {p.rsplit('/', 1)[1].removesuffix('.parquet')} AS SELECT * FROM '{p}'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if v != v else int(v) if v.is_integer() else v
    return v


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - SLOW))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    rows = [tuple(map(plain, r)) for r in df.collect()]
    if name not in catalog.ORACLE:
        assert rows
        return
    cur = duck.execute(catalog.ORACLE[name])
    names = [c[0] for c in cur.description]
    assert sorted(names) == sorted(df.columns)
    at = [names.index(c) for c in df.columns]
    want = [tuple(plain(r[i]) for i in at) for r in cur.fetchall()]
    assert sorted(map(repr, rows)) == sorted(map(repr, want))


def test_every_operator_has_rows():
    assert len(catalog.QUERIES) > 50
    assert set(catalog.ORACLE) <= set(catalog.QUERIES)


def test_posting_extract_parses_each_page_once_in_many_tasks(spark):
    """20,000 parts of one small file; the filter on the result has no parse of its own."""
    df = catalog.posting_extract(spark, "/root/testdata/sf0.1")
    assert df._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython [") == 1
    assert df.rdd.getNumPartitions() == 10
