"""Every core query with SQL gives the SQL's rows on the smallest tables."""

import glob
import os

import duckdb
import pandas as pd
import pytest

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")


def plain(v):
    if v is None or v is pd.NaT or v is pd.NA or isinstance(v, float) and v != v:
        return ""
    if hasattr(v, "isoformat"):
        return str(pd.Timestamp(v))
    return f"{float(v):.6f}" if not isinstance(v, (str, bool)) and hasattr(v, "__float__") else str(v)


def table(df):
    df = df[sorted(df.columns)]
    return sorted(tuple(map(plain, r)) for r in df.itertuples(index=False))


def views():
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def test_core_queries(spark):
    from tidewatch.plans import items, reference, timestamps

    con = views()
    for catalogue in (reference.CATALOGUE, timestamps.CATALOGUE, items.CATALOGUE):
        for name, query in catalogue.queries.items():
            got = query(spark, DATA).toPandas()
            if name in catalogue.sql:
                want = con.sql(catalogue.sql[name]).df()
                assert sorted(got.columns) == sorted(want.columns), name
                assert table(got) == table(want), name


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
