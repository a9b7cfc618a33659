"""Every registered query that has a SQL form, against DuckDB on the smallest tables."""

from pathlib import Path

import pandas as pd
import pytest

import __spark_entry__ as contract

DATA = Path("/root/testdata/sf0.001")
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()

pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    connection = duckdb.connect()
    for t in TABLES:
        connection.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return connection


def rows(df: pd.DataFrame) -> list:
    df = df[sorted(df.columns)]
    plain = [tuple(None if pd.isna(v) else v for v in r) for r in df.itertuples(index=False, name=None)]
    return sorted(plain, key=str)


def test_names():
    assert set(contract.oracle_sql()) <= set(contract.queries())


def test_entry(spark):
    assert contract.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(contract.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    got = contract.queries()[name](spark, str(DATA)).toPandas()
    want = duck.sql(contract.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
