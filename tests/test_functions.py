import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tablesync import config
from tablesync.functions import lsn, pgtypes, scalar
from tablesync.operators.schema import ColumnChange, schema_diff
from tablesync.state import IllegalTransition, move


@given(st.integers(0, 2**63 - 1))
def test_lsn_text_round_trip(n):
    assert lsn.parse_text(lsn.show_number(n)) == n


def test_lsn_columns(spark):
    rows = [(0,), (1,), (2**32,), (2**63 - 1,), (None,)]
    got = spark.createDataFrame(rows, "n bigint").select("n", lsn.parse(lsn.show(F.col("n"))).alias("m")).collect()
    assert all(r.n == r.m for r in got)
    bad = spark.createDataFrame([("x",), ("1",), ("1/2/3",), ("",)], "s string").select(lsn.parse(F.col("s")).alias("n")).collect()
    assert [r.n for r in bad] == [0, 0, 0, 0] and lsn.parse_text("junk") == 0


def test_backoff_twins(spark):
    got = spark.createDataFrame([(n,) for n in range(3, 15)], "n int").select("n", scalar.backoff_seconds(F.col("n")).alias("s")).collect()
    assert [r.s for r in got] == [scalar.backoff(r.n) for r in got]
    assert [scalar.backoff(n) for n in (3, 4, 5, 9, 12)] == [30, 60, 120, 1920, 1920]


def test_moving_average_and_median(spark):
    d = spark.createDataFrame([([100, 200, 50],), ([],)], "x array<bigint>")
    assert [r.a for r in d.select(scalar.moving_average(F.col("x")).alias("a")).collect()] == [106, 0]
    assert [r.m for r in d.select(scalar.upper_median(F.col("x"), 1).alias("m")).collect()] == [100, 1]
    assert [r.m for r in d.select(scalar.upper_median(F.col("x"), 1000).alias("m")).collect()] == [1000, 1000]


def test_redaction():
    assert "secret" not in scalar.redact("host=h password=secret user=u") and "secret" not in scalar.redact("postgres://u:secret@h/db")
    assert "se cret" not in scalar.redact("host=h password='se cret' broken ===")
    assert scalar.quote_ident('a"b') == '"a""b"' and scalar.quote_literal("a'b") == "'a''b'"


def test_types(spark):
    row = [("t", "7", "-3", "1.5", "2024-02-29", '{1,NULL,"3"}', '{"a,b",c}', "1 year 2 mons 3 days 04:05:06.5", "")]
    d = spark.createDataFrame(row, "b string, i string, s string, f string, d string, ia string, ta string, iv string, e string")
    r = d.select(*[pgtypes.parse(F.col(c), oid).alias(c) for c, oid in (("b", 16), ("i", 20), ("s", 21), ("f", 701), ("d", 1082), ("ia", 1007), ("ta", 1009), ("iv", 1186), ("e", 25))]).first()
    assert (r.b, r.i, r.s, r.f, str(r.d), r.ia, r.ta, r.e) == (True, 7, -3, 1.5, "2024-02-29", [1, None, 3], ["a,b", "c"], "")
    assert (r.iv.months, r.iv.days, r.iv.micros) == (14, 3, 14706500000)
    assert pgtypes.spark_type(1700, ((10 << 16) | 2) + 4) == "decimal(10,2)"
    with pytest.raises(pgtypes.UnsupportedType):
        pgtypes.spark_type(17)


def test_schema_diff():
    old = [("id", 23), ("a", 25), ("b", 23)]
    assert schema_diff(old, old) == []
    assert schema_diff(old, [("id", 23), ("a", 25)]) == [ColumnChange("drop", "b")]
    assert schema_diff(old, [*old, ("c", 16)]) == [ColumnChange("add", "c", "boolean")]
    assert schema_diff(old, [("id", 23), ("a2", 25), ("b", 23)]) == [ColumnChange("rename", "a", "a2")]
    assert [c.kind for c in schema_diff(old, [("id", 20), ("a", 25), ("c", 23)])] == ["retype"]


def test_config_messages():
    for key, value, said in (("duckdb_threads", "not_a_number", "'duckdb_threads' must be an integer, got 'not_a_number'"), ("duckdb_threads", "-1", "'duckdb_threads' must be positive, got -1"), ("ducklake_catalog_connstr", "", "'ducklake_catalog_connstr' must be a non-empty string")):
        with pytest.raises(config.ConfigError, match=said):
            config.checked(key, value)
    with pytest.raises(config.ConfigError, match="unknown config key: 'x'"):
        config.checked("x", "1")
    with pytest.raises(config.ConfigError, match="'routing_enabled' must be true or false, got 'maybe'"):
        config.checked("routing_enabled", "maybe", table=True)
    assert config.for_table(config.resolved({"duckdb_threads": 2}, {"duckdb_threads": 3}), {"flush_interval_ms": 9})["duckdb_threads"] == 3


def test_states():
    assert move("SNAPSHOT", "CATCHUP") == "CATCHUP" and move("STREAMING", "STREAMING") == "STREAMING"
    with pytest.raises(IllegalTransition):
        move("PENDING", "CATCHUP")
