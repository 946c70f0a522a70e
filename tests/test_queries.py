"""Every query of the engine against its SQL in DuckDB."""

import os

import duckdb
import pytest

from tablesync.queries import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DATA}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, duck):
    got = QUERIES[name](spark, DATA)
    cols = sorted(got.columns)
    mine = sorted(repr(tuple(r)) for r in got.select(*cols).collect())
    theirs = duck.execute(f"SELECT {', '.join(cols)} FROM ({ORACLES[name]})").fetchall()
    assert mine == sorted(map(repr, theirs))


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
