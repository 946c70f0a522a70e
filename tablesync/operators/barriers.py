"""Barriers: truncates and schema changes that split a batch of changes into ordered segments."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from .changes import SCHEMA, TRUNCATE


def barriers(changes: DataFrame) -> list[Row]:
    """Barrier rows in order; they are few, one per statement on the source."""
    return changes.where(F.col("op").isin(TRUNCATE, SCHEMA)).select("lsn", "seq", "op", *(["ddl"] if "ddl" in changes.columns else [])).orderBy("lsn", "seq").collect()


def between(changes: DataFrame, low: tuple[int, int] | None, high: tuple[int, int] | None) -> DataFrame:
    """Row changes strictly between two positions; no low or high is open."""
    at = F.struct("lsn", "seq")
    place = lambda p: F.struct(F.lit(p[0]).cast("bigint").alias("lsn"), F.lit(p[1]).cast("bigint").alias("seq"))
    rows = changes.where(F.col("op") < TRUNCATE)
    if low is not None:
        rows = rows.where(at > place(low))
    return rows if high is None else rows.where(at < place(high))


def segments(changes: DataFrame) -> Iterator[tuple[DataFrame, Row | None]]:
    """The changes before each barrier with that barrier, then those after the last with None."""
    low = None
    for b in barriers(changes):
        yield between(changes, low, (b.lsn, b.seq)), b
        low = (b.lsn, b.seq)
    yield between(changes, low, None), None


def since_truncate(changes: DataFrame) -> DataFrame:
    """What a truncate leaves of a change log: the row changes after the last one, as one plan."""
    last = changes.where(F.col("op") == TRUNCATE).agg(F.max(F.struct("lsn", "seq")).alias("t"))
    return changes.where(F.col("op") < TRUNCATE).join(F.broadcast(last), F.col("t").isNull() | (F.struct("lsn", "seq") > F.col("t"))).drop("t")
