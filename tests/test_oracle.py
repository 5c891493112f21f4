"""Each registered query with SQL gives the rows that DuckDB gives, on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__

SF = "/root/testdata/sf0.001"
NAMES = sorted(__spark_entry__.oracle_sql())


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(SF):
        if f.endswith(".parquet"):
            c.execute(f"create view {f[:-8]} as select * from '{SF}/{f}'")
    return c


def as_key(row):
    return tuple("" if v is None else repr(float(v)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v) for v in row)


@pytest.mark.parametrize("name", NAMES)
def test_rows_equal(spark, con, name):
    df = __spark_entry__.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(as_key(r[c] for c in columns) for r in df.collect())
    cur = con.execute(__spark_entry__.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == columns
    assert got == sorted(as_key(r[names.index(c)] for c in columns) for r in cur.fetchall())


def test_names():
    assert set(NAMES) <= __spark_entry__.queries().keys()
