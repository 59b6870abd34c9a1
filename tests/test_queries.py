"""Every query with SQL gives the rows that DuckDB gives."""

import duckdb
import pandas as pd
import pytest

import gristmill.queries as q
from conftest import DATA

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(df):
    def plain(x):
        if x is None or x is pd.NA or x != x:
            return "NULL"
        x = x.item() if hasattr(x, "item") else x
        return repr(float(x)) if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)

    df = df[sorted(df.columns)].astype(object)
    return sorted(tuple(map(plain, r)) for r in df.itertuples(index=False))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(q.ORACLE_SQL))
def test_same_rows(spark, duck, name):
    assert rows(q.QUERIES[name](spark, DATA).toPandas()) == rows(duck.execute(q.ORACLE_SQL[name]).df())


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 4
    assert set(q.QUERIES) <= set(e.queries())
