"""Every catalogue query against its DuckDB SQL at the smallest scale."""

import duckdb
import pytest

from siftline.plans.files import QUERIES, SQL

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    return con


def ordered(df):
    df = df[sorted(df.columns)].astype(str)
    return df.sort_values(list(df.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, duck, name):
    ours, theirs = ordered(QUERIES[name](spark, DATA).toPandas()), ordered(duck.sql(SQL[name]).df())
    assert list(ours.columns) == list(theirs.columns)
    assert ours.equals(theirs)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    df = QUERIES[name](spark, DATA)
    assert df.count() >= 0 and df.columns
