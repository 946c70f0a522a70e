"""Scalar rules of the sync engine as column expressions, with Python twins where the driver needs them."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Units of size texts, decimal and binary.
UNITS = {"B": 1, "BYTES": 1, "KB": 10**3, "MB": 10**6, "GB": 10**9, "TB": 10**12, "KIB": 2**10, "MIB": 2**20, "GIB": 2**30, "TIB": 2**40}
BACKOFF_BASE_S, BACKOFF_MOST, ERROR_LIMIT = 30, 6, 3
POLL_MS = (100, 2000)


def size_bytes(text: Column) -> Column:
    """`512 MB` or `1.5 GiB` to bytes; 0 where it can't be read."""
    number = F.regexp_extract(text, r"^\s*([0-9.]+)", 1).try_cast("double")
    unit = F.upper(F.regexp_extract(text, r"^\s*[0-9.]+\s*([A-Za-z]*)\s*$", 1))
    factor = F.element_at(F.create_map(*[x for k, v in {**UNITS, "": 1}.items() for x in (F.lit(k), F.lit(float(v)))]), unit)
    return F.coalesce((number * factor).cast("bigint"), F.lit(0).cast("bigint"))


def backoff_seconds(failures: Column) -> Column:
    """Seconds until the next try after the n-th failure in a row, n >= ERROR_LIMIT."""
    return (F.lit(BACKOFF_BASE_S) * F.pow(F.lit(2.0), F.greatest(F.lit(0), F.least(failures - ERROR_LIMIT, F.lit(BACKOFF_MOST))))).cast("bigint")


def backoff(failures: int) -> int:
    return BACKOFF_BASE_S << max(0, min(failures - ERROR_LIMIT, BACKOFF_MOST))


def poll_wait_ms(poll_ms: Column) -> Column:
    """Wait for a cycle's first message: half the poll interval, within bounds."""
    return F.least(F.greatest((poll_ms / 2).cast("bigint"), F.lit(POLL_MS[0])), F.lit(POLL_MS[1])).cast("bigint")


def upper_median(values: Column, least: int) -> Column:
    """The upper median of an array, `least` at least, also where the array is empty."""
    mid = F.try_element_at(F.array_sort(values), (F.floor(F.size(values) / 2) + 1).cast("int"))
    return F.greatest(F.coalesce(mid.cast("bigint"), F.lit(least)), F.lit(least).cast("bigint"))


def moving_average(values: Column, weight: float = 0.3) -> Column:
    """Exponential average of an array in order, cut to a whole number at each step; the first value (or one after 0) stands alone."""
    return F.aggregate(values, F.lit(0).cast("bigint"), lambda acc, x: F.when(acc == 0, x.cast("bigint")).otherwise((F.lit(weight) * x + F.lit(1 - weight) * acc).cast("bigint")))


def nearest_rank(values: Column, percent: int) -> Column:
    """The smallest value that at least `percent` of an array's values don't exceed; for short histories, see operators.stats for groups."""
    rank = F.greatest(F.lit(1), F.ceil(F.size(values) * F.lit(percent) / 100)).cast("int")
    return F.try_element_at(F.array_sort(values), rank)


def variation(value: Column) -> Column:
    """Coefficient of variation as an aggregate: population deviation over the mean; null for a mean of 0."""
    return F.stddev_pop(value) / F.nullif(F.avg(value), F.lit(0.0))


def slope(y: Column, x: Column) -> Column:
    """Least-squares slope as an aggregate."""
    return F.regr_slope(y, x)


def row_bytes(columns: list[tuple[str, str]], per_row: int = 0) -> Column:
    """Estimated bytes of a row: fixed widths by type, and the UTF-8 length of texts."""
    fixed = sum(FIXED_WIDTH.get(kind, 0) for _, kind in columns) + per_row
    texts = [F.coalesce(F.octet_length(F.col(name)), F.lit(0)) for name, kind in columns if kind not in FIXED_WIDTH]
    return sum(texts, F.lit(fixed)).cast("bigint")


#: Widths of types that don't vary, in bytes.
FIXED_WIDTH = {"boolean": 1, "smallint": 2, "int": 4, "bigint": 8, "float": 4, "double": 8, "date": 4, "timestamp": 8, "timestamp_ntz": 8}


def table_name(text: Column, default_schema: str = "public") -> Column:
    """(schema, name) of `schema.name`; a bare name gets the default schema."""
    dot = F.instr(text, ".") > 0
    return F.struct(F.when(dot, F.split_part(text, F.lit("."), F.lit(1))).otherwise(default_schema).alias("schema"), F.when(dot, F.regexp_extract(text, r"(?s)^[^.]*\.(.*)$", 1)).otherwise(text).alias("name"))


def split_name(text: str, default_schema: str = "public") -> tuple[str, str]:
    schema, dot, name = text.partition(".")
    return (schema, name) if dot else (default_schema, text)


def source_label(group: str, schema: str, table: str) -> str:
    return f"{group}/{schema}.{table}"


def redact(conninfo: str) -> str:
    """A connection string without its password, in key=value or URL form; unreadable ones lose all that looks like one."""
    out = re.sub(r"(?i)(password\s*=\s*)('(?:[^'\\]|\\.)*'|\S+)", r"\1***", conninfo)
    return re.sub(r"(?i)^(\w+://[^:/@\s]+):[^@\s]*@", r"\1:***@", out)


def quote_ident(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def quote_literal(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def percentile(values: list[float], percent: int) -> float | None:
    ordered = sorted(values)
    return ordered[max(0, math.ceil(len(ordered) * percent / 100) - 1)] if ordered else None
