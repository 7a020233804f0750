"""Strict text forms of dates and timestamps, and values as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.scalar import col

DATE = r"^([0-9]{4}-[0-9]{2}-[0-9]{2})"
TIMESTAMP = r"^([0-9]{4}-[0-9]{2}-[0-9]{2})[ T]([0-9]{2}:[0-9]{2}:[0-9]{2})(\.[0-9]{1,6})?"


def parse_date(c: str | Column, strict: bool = True) -> Column:
    """``YYYY-MM-DD`` with exact digits and a calendar check; text after it is ignored.

    Anything else raises, or gives null if not ``strict``.
    """
    value = F.try_to_timestamp(F.regexp_extract(col(c), DATE, 1), F.lit("yyyy-MM-dd")).cast("date")
    return _checked(c, value, strict, "date")


def parse_timestamp(c: str | Column, strict: bool = True) -> Column:
    """``YYYY-MM-DD HH:MM:SS[.f{1,6}]`` or with ``T``; more fraction digits are cut, the time part is required."""
    parts = [F.regexp_extract(col(c), TIMESTAMP, i) for i in (1, 2, 3)]
    value = F.concat(parts[0], F.lit(" "), parts[1], parts[2]).try_cast("timestamp_ntz")
    value = F.when(parts[1] != "", value)
    return _checked(c, value, strict, "timestamp")


def _checked(c: str | Column, value: Column, strict: bool, what: str) -> Column:
    if not strict:
        return value
    bad = col(c).isNotNull() & value.isNull()
    return F.when(bad, F.raise_error(F.concat(F.lit(f"not a {what}: "), col(c)))).otherwise(value)


def to_text(c: str | Column, dtype: T.DataType) -> Column:
    """A value as text: booleans as 0 and 1, timestamps with a six-digit fraction only where it isn't zero."""
    x = col(c)
    if isinstance(dtype, T.BooleanType):
        return x.cast("int").cast("string")
    if isinstance(dtype, (T.TimestampNTZType, T.TimestampType)):
        full = F.date_format(x, "yyyy-MM-dd HH:mm:ss.SSSSSS")
        return F.when(full.endswith(".000000"), F.substring(full, 1, 19)).otherwise(full)
    if isinstance(dtype, T.DateType):
        return F.date_format(x, "yyyy-MM-dd")
    return x.cast("string")
