"""Every query against its SQL, row by row."""

import glob
import os

import duckdb
import pytest

from regnet.oracles import ORACLE_SQL
from regnet.queries import QUERIES


@pytest.fixture(scope="module")
def con(data):
    c = duckdb.connect()
    for f in glob.glob(f"{data}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def rows(found, order):
    return sorted((tuple(round(x, 5) + 0.0 if isinstance(x, float) else x for x in (r[i] for i in order)) for r in found), key=str)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_rows_as_sql(name, spark, con, data):
    df = QUERIES[name](spark, data)
    cols = sorted(df.columns)
    got = rows(df.collect(), [df.columns.index(c) for c in cols])
    r = con.execute(ORACLE_SQL[name])
    names = [d[0] for d in r.description]
    assert sorted(names) == cols
    assert got == rows(r.fetchall(), [names.index(c) for c in cols])


def test_queries_without_sql_run(spark, data):
    for name in set(QUERIES) - set(ORACLE_SQL):
        assert QUERIES[name](spark, data).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns
    assert set(e.oracle_sql()) <= set(e.queries())
