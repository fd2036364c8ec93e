"""The driver's view: registered names, and results against SQL on the smallest data."""

import os

import duckdb
import pytest

import __spark_entry__

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


def test_sql_has_queries():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@needs_data
def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


def plain(v):
    if isinstance(v, float):
        return round(v, 9)
    return v if isinstance(v, (int, str, bool, type(None))) else str(v)


@needs_data
@pytest.mark.parametrize("name", sorted(__spark_entry__.catalogue.SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    want = con.sql(__spark_entry__.catalogue.SQL[name])
    cols = sorted(want.columns)
    df = __spark_entry__.catalogue.QUERIES[name](spark, DATA)
    assert sorted(df.columns) == cols
    rows = sorted((tuple(map(plain, r)) for r in df.select(*cols).collect()), key=repr)
    assert rows == sorted((tuple(map(plain, r)) for r in want.select(*[f'"{c}"' for c in cols]).fetchall()), key=repr)
