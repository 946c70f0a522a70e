"""Compaction: the last change of each key."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .changes import live


def last_per_key(changes: DataFrame, keys: list[str]) -> DataFrame:
    """The change of the greatest (lsn, seq) of each key, deletes included.

    row_number() = 1 lets Catalyst put a group limit on both sides of the shuffle, so a key with
    many changes sends one row a task.
    """
    turn = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("lsn"), F.desc("seq")))
    return changes.withColumn("_turn", turn).where("_turn = 1").drop("_turn")


def upserted(base: DataFrame, changes: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """base after changes: rows of changed keys go, the last live row of each comes."""
    last = last_per_key(changes, keys)
    kept = base.select(*columns).join(last.select(*keys), keys, "left_anti")
    return kept.unionByName(live(last).select(*columns))
