"""Every query with SQL gives the same rows as DuckDB; every other one gives rows."""

import math
from decimal import Decimal

import duckdb
import pytest
from conftest import SF

from cinequarry.plans.catalogue import ORACLE_SQL, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, Decimal):
        v = float(v)
    return ("nan" if math.isnan(v) else round(v, 6) + 0.0) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    rows = sorted([tuple(plain(r[c]) for c in columns) for r in df.collect()], key=str)
    if name not in ORACLE_SQL:
        assert rows
        return
    told = duck.sql(ORACLE_SQL[name])
    assert sorted(told.columns) == columns
    places = [told.columns.index(c) for c in columns]
    assert rows == sorted([tuple(plain(r[i]) for i in places) for r in told.fetchall()], key=str)


def test_known_histogram(spark):
    got = {r.bucket: r.clips for r in QUERIES["q01_bucket_histogram"](spark, "/root/testdata/sf0.01").collect()}
    assert got == {"10s_288x512": 391, "10s_512x288": 113, "10s_512x384": 192, "20s_512x288": 113, "20s_512x384": 191}


def test_entry_module(spark):
    import __spark_entry__ as e

    assert set(ORACLE_SQL) <= set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0
