"""Snapshots of source tables as files: Parquet by choice, CSV where a source can't write it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: What stands for null in CSV, where an empty field is an empty text.
NULL = "__NULL__"


def write_csv(rows: DataFrame, path: str) -> None:
    """CSV that keeps empty texts, nulls, quotes, separators and line breaks apart."""
    rows.write.option("header", True).option("quoteAll", True).option("escape", '"').option("nullValue", NULL).option("emptyValue", "").csv(path)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of CSV files; as texts may hold line breaks, a file is one task's work."""
    return spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').option("nullValue", NULL).option("emptyValue", "").option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def read(spark: SparkSession, path: str | list[str], schema: str | None = None, form: str = "parquet") -> DataFrame:
    """A snapshot of one table; several paths are partitions of it."""
    paths = [path] if isinstance(path, str) else path
    if form == "csv":
        parts = [read_csv(spark, p, schema) for p in paths]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.format(form).load(paths)
