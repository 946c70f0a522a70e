"""Statistics over groups of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def nearest_ranks(rows: DataFrame, keys: list[str], value: str, percents: dict[str, int]) -> DataFrame:
    """keys and, by name, the smallest value that at least so many percent of a group's don't exceed.

    Ranks come from a sort that can spill; no group is gathered into an array.
    """
    group = Window.partitionBy(*keys)
    ranked = rows.where(F.col(value).isNotNull()).select(*keys, value, F.row_number().over(group.orderBy(value)).alias("_rank"), F.count("*").over(group).alias("_n"))
    at = lambda p: F.greatest(F.lit(1), F.ceil(F.col("_n") * F.lit(p) / 100))
    return ranked.groupBy(*keys).agg(*[F.max(F.when(F.col("_rank") == at(p), F.col(value))).alias(name) for name, p in percents.items()])
