"""Every query with SQL gives what DuckDB gives on the smallest tables."""

import os

import duckdb
import pytest

from folioloom.plans import model_queries, sink_queries  # noqa: F401 - add to the queries of plans
from folioloom.plans import queries as plans
from folioloom.streaming import queries as streams

DATA = "/root/testdata/sf0.001"
ALL = {**plans.QUERIES, **streams.QUERIES}
SQL = {**plans.ORACLE, **streams.ORACLE}

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    return c


def rows(df):
    cols = sorted(df.columns)
    df = df[cols].astype(object)
    return cols, sorted((tuple(r) for r in df.where(df.notna(), None).values.tolist()), key=repr)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, duck, name):
    cols, got = rows(ALL[name](spark, DATA).toPandas())
    wanted_cols, want = rows(duck.execute(SQL[name]).df())
    assert cols == wanted_cols and len(got) == len(want)
    for a, b in zip(got, want):
        assert all(x == y or (isinstance(x, (int, float)) and isinstance(y, (int, float)) and abs(x - y) < 1.5e-6) for x, y in zip(a, b)), (a, b)
