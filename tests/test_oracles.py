"""Every registered query against its SQL on the smallest data set."""

import os

import duckdb
import pytest

import __spark_entry__ as contract
from tools.check import TABLES, rows_of

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES.split():
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(contract.queries()))
def test_query(spark, con, name):
    df = contract.queries()[name](spark, SF)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    sql = contract.oracle_sql().get(name)
    if sql is None:
        assert got
        return
    cur = con.execute(sql)
    columns = [c[0] for c in cur.description]
    assert sorted(df.columns) == sorted(columns)
    assert got == rows_of(columns, cur.fetchall())


def test_entry(spark):
    assert contract.entry(spark).count() > 0
