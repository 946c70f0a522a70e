"""Log positions: 64-bit numbers shown as two hexadecimal halves."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LOW = (1 << 32) - 1


def parse(text: Column) -> Column:
    """`hi/lo` to BIGINT; text of any other form is 0, null stays null."""
    good = text.rlike(r"^[0-9A-Fa-f]{1,8}/[0-9A-Fa-f]{1,8}$")
    half = lambda n: F.conv(F.split_part(text, F.lit("/"), F.lit(n)), 16, 10).cast("bigint")
    return F.when(text.isNull(), F.lit(None).cast("bigint")).when(good, F.shiftleft(half(1), 32).bitwiseOR(half(2))).otherwise(F.lit(0).cast("bigint"))


def show(lsn: Column) -> Column:
    """BIGINT to `hi/lo`."""
    lsn = lsn.cast("bigint")
    return F.concat(F.hex(F.shiftrightunsigned(lsn, 32)), F.lit("/"), F.hex(lsn.bitwiseAND(F.lit(LOW))))


def behind(ahead: Column, at: Column) -> Column:
    """Distance from `at` to `ahead`, never below 0."""
    return F.greatest(ahead - at, F.lit(0).cast("bigint"))


def parse_text(text: str) -> int:
    try:
        high, low = text.split("/")
        return int(high, 16) << 32 | int(low, 16)
    except ValueError:
        return 0


def show_number(lsn: int) -> str:
    return f"{lsn >> 32:X}/{lsn & LOW:X}"
