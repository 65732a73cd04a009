"""Every query with SQL gives DuckDB's rows."""

import datetime
import decimal
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from facetry.plans.registry import QUERIES, SQL


def normal(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return ("null",)
    if isinstance(v, bool) or isinstance(v, int):
        return (type(v).__name__, str(v))
    if isinstance(v, (float, decimal.Decimal)):
        return ("float", repr(round(float(v), 6) + 0.0))
    if isinstance(v, datetime.date):
        return ("time", str(v)[:19])
    return ("str", str(v))


SF_DIRS = os.environ.get("TEST_SF_DIRS", "/root/testdata/sf0.001").split(",")


@pytest.fixture(scope="module", params=SF_DIRS)
def sf_dir(request):
    return request.param


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{sf_dir}/{f}'")
    return con


def compare(spark, duck, sf_dir, query, sql):
    df = query(spark, sf_dir)
    result = duck.execute(sql)
    names = [c[0] for c in result.description]
    assert sorted(df.columns) == sorted(names)
    at = [names.index(c) for c in df.columns]
    theirs = sorted(tuple(normal(r[k]) for k in at) for r in result.fetchall())
    assert sorted(tuple(map(normal, r)) for r in df.collect()) == theirs


@pytest.mark.parametrize("name", sorted(SQL))
def test_rows_match(name, spark, duck, sf_dir):
    compare(spark, duck, sf_dir, QUERIES[name], SQL[name])


def test_index_recall(spark):
    """Over the whole query set, of the largest table."""
    pairs = lambda name: {(r.query_id, r.entity_id) for r in QUERIES[name](spark, "/root/testdata/sf0.1").collect()}
    approx, exact = pairs("knn_index"), pairs("knn_search_cosine")
    assert len(exact) >= 200 and len(approx & exact) >= 0.9 * len(exact)


def test_entry_rows_and_schema(spark):
    df = entry.entry(spark)
    assert df.columns == ["entity_id", "title", "score"] and df.count() > 0


def test_registry_is_whole():
    assert set(SQL) <= set(QUERIES) and set(QUERIES) <= set(entry.queries()) and set(SQL) <= set(entry.oracle_sql())
