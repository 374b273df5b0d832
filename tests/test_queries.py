"""Every registered query of the library against DuckDB on the same tables."""

import datetime
import glob
import os

import duckdb
import pytest

from tessel.queries import ORACLE_SQL, QUERIES, flagship


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for f in glob.glob(f"{small}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def plain(x):
    if isinstance(x, float):
        return repr(round(x, 9) + 0.0)
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None).isoformat()
    return str(x)


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(plain(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, small, duck):
    df = QUERIES[name](spark, small)
    got = table(df.columns, df.collect())
    if name in ORACLE_SQL:
        want = duck.execute(ORACLE_SQL[name])
        assert got == table([c[0] for c in want.description], want.fetchall())
    else:
        assert got[1]


def test_flagship(spark, small):
    assert flagship(spark, small).count() > 0


def test_entry_module(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and set(QUERIES) <= set(e.queries())
    assert e.entry(spark).count() > 0
