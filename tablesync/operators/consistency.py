"""Comparing a target with its source."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def counts(source: DataFrame, target: DataFrame, keys: list[str]) -> DataFrame:
    """One row: rows of the source, of the target, missing from the target, and beyond the source, by key."""
    s, t = source.select(*keys).withColumn("_s", F.lit(1)), target.select(*keys).withColumn("_t", F.lit(1))
    both = s.join(t, keys, "full")
    return both.agg(F.count("_s").alias("source_rows"), F.count("_t").alias("target_rows"), F.count_if(F.col("_t").isNull()).alias("missing_rows"), F.count_if(F.col("_s").isNull()).alias("extra_rows"))


def differences(source: DataFrame, target: DataFrame, keys: list[str]) -> DataFrame:
    """Keys whose rows differ in any value, null-safe, with which side has them."""
    values = [c for c in source.columns if c not in keys]
    s = source.select(*keys, F.struct(*values).alias("_s")) if values else source.select(*keys, F.lit(1).alias("_s"))
    t = target.select(*keys, F.struct(*values).alias("_t")) if values else target.select(*keys, F.lit(1).alias("_t"))
    side = F.when(F.col("_t").isNull(), "missing").when(F.col("_s").isNull(), "extra").otherwise("changed")
    return s.join(t, keys, "full").where(~F.col("_s").eqNullSafe(F.col("_t"))).select(*keys, side.alias("difference"))
