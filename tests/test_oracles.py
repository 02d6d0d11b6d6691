"""Every query with SQL gives the rows that DuckDB gives; the others run and give rows."""

import glob
import math
import os

import duckdb
import pytest

from specaudit.plans.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


def shown(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "-"
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, float):
        v = round(v, 6) + 0.0
        return str(int(v)) if v == int(v) else repr(v)
    return str(v)


def rows(frame):
    columns = sorted(frame.columns)
    return columns, sorted(tuple(map(shown, r)) for r in frame[columns].astype(object).where(frame[columns].notna(), None).values.tolist())


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    assert rows(QUERIES[name](spark, SF).toPandas()) == rows(duck.execute(ORACLE_SQL[name]).df())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_query_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0
