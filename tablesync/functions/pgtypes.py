"""Source column types: object ids, Spark types, and parsing of their text form."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Object id, source type name, Spark type.
TYPES = (
    (16, "boolean", "boolean"), (20, "bigint", "bigint"), (21, "smallint", "smallint"), (23, "integer", "int"), (25, "text", "string"), (26, "oid", "bigint"), (114, "json", "string"), (700, "real", "float"), (701, "double precision", "double"), (1042, "char", "string"), (1043, "varchar", "string"), (1082, "date", "date"), (1083, "time", "string"), (1114, "timestamp", "timestamp_ntz"), (1184, "timestamptz", "timestamp"), (1186, "interval", "struct<months:int,days:int,micros:bigint>"), (1700, "numeric", "decimal(38,18)"), (2950, "uuid", "string"), (3802, "jsonb", "string"),
)
NAME_OF = {oid: name for oid, name, _ in TYPES}
SPARK_OF = {oid: spark for oid, _, spark in TYPES}
#: Object id of an array type, and of its elements.
ARRAYS = {1000: 16, 1005: 21, 1007: 23, 1016: 20, 1021: 700, 1022: 701, 1009: 25, 1015: 1043, 1115: 1114, 1182: 1082, 1231: 1700, 2951: 2950}
#: Source types that can't be synced.
REFUSED = {17: "bytea", 2249: "record", 3904: "int4range", 3906: "numrange", 3908: "tsrange", 3910: "tstzrange", 3912: "daterange", 3926: "int8range"}


class UnsupportedType(ValueError):
    pass


def type_name(oid: int) -> str:
    return NAME_OF.get(oid) or (f"{NAME_OF[ARRAYS[oid]]}[]" if oid in ARRAYS else "text")


def spark_type(oid: int, modifier: int = -1) -> str:
    """The Spark type of a column; unknown types (enumerations among them) are text."""
    if oid in REFUSED:
        raise UnsupportedType(f"type {REFUSED[oid]} is not supported")
    if oid in ARRAYS:
        return f"array<{spark_type(ARRAYS[oid])}>"
    if oid == 1700 and modifier >= 4:
        return f"decimal({(modifier - 4) >> 16 & 0xFFFF},{(modifier - 4) & 0x7FF})"
    return SPARK_OF.get(oid, "string")


def parse(text: Column, oid: int, modifier: int = -1, strict: bool = True) -> Column:
    """The typed value of a text; strict raises on text that doesn't fit, else it is null."""
    kind = spark_type(oid, modifier)
    cast = (lambda c, t: c.cast(t)) if strict else (lambda c, t: c.try_cast(t))
    if kind == "string":
        return text
    if kind == "boolean":
        return F.when(text == "t", F.lit(True)).when(text == "f", F.lit(False)).otherwise(cast(text, "boolean"))
    if kind.startswith("array<"):
        return parse_array(text, ARRAYS[oid], strict)
    if kind.startswith("struct<"):
        return parse_interval(text)
    return cast(text, kind)


def parse_array(text: Column, oid: int, strict: bool = True) -> Column:
    """A one-dimensional array literal such as {1,NULL,"a,b"}."""
    inner = F.regexp_extract(text, r"(?s)^\{(.*)\}$", 1)
    items = F.regexp_extract_all(inner, F.lit(r'(?s)("(?:[^"\\]|\\.)*"|[^,"]+)'), 1)
    plain = lambda x: F.when(x.startswith('"'), F.regexp_replace(x.substr(F.lit(2), F.length(x) - 2), r"\\(.)", "$1")).when(F.upper(x) != "NULL", x)
    return F.when(text.isNotNull(), F.transform(items, lambda x: parse(plain(x), oid, strict=strict)))


def parse_interval(text: Column) -> Column:
    """An interval in the source's usual form: `1 year 2 mons 3 days 04:05:06.7`."""
    number = lambda unit: F.coalesce(F.regexp_extract(text, rf"(-?\d+) {unit}", 1).try_cast("int"), F.lit(0))
    sign = F.when(F.regexp_extract(text, r"(-?)\d+:\d+:\d+", 1) == "-", -1).otherwise(1)
    part = lambda k: F.coalesce(F.regexp_extract(text, r"(\d+):(\d+):(\d+(?:\.\d+)?)", k).try_cast("decimal(20,6)"), F.lit(0))
    micros = (sign * (part(1) * 3600 + part(2) * 60 + part(3)) * 1000000).cast("bigint")
    return F.when(text.isNotNull(), F.struct((number("year") * 12 + number("mon")).alias("months"), number("day").alias("days"), micros.alias("micros")))
