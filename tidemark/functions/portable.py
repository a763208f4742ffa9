"""Expressions that give the same value in Spark and in other SQL engines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def h32(*parts: Column | str | int) -> Column:
    """A 32-bit hash of the parts: the first eight hexadecimal digits of an MD5, as a number."""
    cols = [p if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    return F.conv(F.substring(F.md5(F.concat_ws("|", *(c.cast("string") for c in cols)).cast("binary")), 1, 8), 16, 10).cast("long")


def h32_sql(*parts: str) -> str:
    """The same in SQL text; parts are SQL expressions."""
    return f"('0x' || substr(md5(concat_ws('|', {', '.join(parts)})), 1, 8))::BIGINT"


def rounded(x: Column, digits: int) -> Column:
    """Rounded half away from zero on the scaled double, as other engines round; a small negative number becomes -0.0."""
    scale = 10.0**digits
    return F.when(x < 0, -(F.round(-x * scale) / scale)).otherwise(F.round(x * scale) / scale)
