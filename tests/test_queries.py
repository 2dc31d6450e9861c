"""Every registered query of the library against its SQL on the smallest tables."""

import os

import duckdb
import numpy as np
import pytest

from spliceflow.queries import ORACLE_SQL, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(data):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{os.path.join(data, t)}.parquet'")
    return c


def canonical(df):
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if df[c].dtype == object:
            df[c] = df[c].map(lambda v: "" if v is None or (isinstance(v, float) and np.isnan(v)) else str(v))
    return df.sort_values(list(df.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, duck, data, name):
    got = canonical(QUERIES[name](spark, data).toPandas())
    want = canonical(duck.execute(ORACLE_SQL[name]).df())
    assert list(got.columns) == list(want.columns)
    assert len(got) == len(want)
    for c in got.columns:
        assert (((got[c] == want[c]) | (got[c].isna() & want[c].isna()))).all(), c


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_query_without_sql_runs(spark, data, name):
    assert QUERIES[name](spark, data).count() > 0
