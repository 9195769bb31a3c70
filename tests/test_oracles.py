"""Every query with SQL gives what the SQL gives."""

import math
from collections import Counter

import duckdb
import pandas as pd
import pytest
from conftest import DATA

from strataloom.plans.catalog import ORACLE_SQL, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SF = f"{DATA}/sf0.001"


def plain(v):
    if v is None or v is pd.NA or v is pd.NaT or isinstance(v, float) and math.isnan(v):
        return None
    return float(v) if not isinstance(v, str | bool) and hasattr(v, "__float__") else v


def rows(pdf):
    return Counter(tuple(plain(v) for v in r) for r in pdf[sorted(pdf.columns)].itertuples(index=False))


def sql_rows(sql):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con.sql(sql).df()


@pytest.mark.parametrize("name", list(ORACLE_SQL))
def test_matches_sql(spark, name):
    got, want = QUERIES[name](spark, SF).toPandas(), sql_rows(ORACLE_SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in ORACLE_SQL])
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 10
    assert set(e.oracle_sql()) <= set(e.queries())
