"""Training-data queries with SQL against DuckDB."""

import glob
import os

import duckdb
import pytest

from specaudit.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, name):
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    got, expect = QUERIES[name](spark, SF).toPandas(), c.execute(ORACLE_SQL[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(expect.columns)
    assert sorted(map(tuple, got[columns].astype(str).values.tolist())) == sorted(map(tuple, expect[columns].astype(str).values.tolist()))


def test_every_operator_has_one_query():
    assert [int(n[2:].split("_")[0]) for n in QUERIES] == list(range(1, len(QUERIES) + 1))
