"""The folder that all executors share, and tables written there to cut a plan."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or a local folder where that is unset (tests)."""
    return (spark.conf.get("spark.checkpoint.dir", None) or "/tmp/tablesync-checkpoints").rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df, written to the shared folder and read back: computed once, whatever executors are lost later."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
