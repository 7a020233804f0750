"""Scalar expressions. All are JVM-side Catalyst expressions; there are no UDFs.

Comparison and boolean operators need no wrapper: use ``Column``'s own
``< <= > >= == != & | ~``.
"""

from __future__ import annotations

from collections.abc import Iterable
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WIDE = "decimal(38,0)"


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def const(value: Any, dtype: str | None = None) -> Column:
    """Literal, cast to ``dtype`` if given."""
    lit = F.lit(value)
    return lit.cast(dtype) if dtype else lit


def variable(name: str, df: DataFrame | None = None, dtype: str | None = None) -> Column:
    """Column reference; with ``df`` and ``dtype`` it asserts the column's type first."""
    if df is not None and dtype is not None:
        actual = df.schema[name].dataType.simpleString()
        if actual != dtype:
            raise TypeError(f"column {name} is {actual}, expected {dtype}")
    return F.col(name)


def negate(c: str | Column) -> Column:
    return ~col(c)


def minute_of(c: str | Column) -> Column:
    """Minute of the hour, 0 to 59, as smallint; floors before the epoch as well."""
    return F.minute(col(c)).cast("smallint")


def trunc_minute(c: str | Column) -> Column:
    """Timestamp floored to the minute; stays without zone."""
    return F.date_trunc("minute", col(c)).cast("timestamp_ntz")


def byte_length(c: str | Column) -> Column:
    """UTF-8 bytes of a string, as bigint."""
    return F.octet_length(col(c)).cast("bigint")


def add(a: str | Column, b: str | Column) -> Column:
    return col(a) + col(b)


def sub(a: str | Column, b: str | Column) -> Column:
    return col(a) - col(b)


def mul(a: str | Column, b: str | Column, wide: bool = False) -> Column:
    """Product; ``wide`` computes exactly in 38 digits and raises beyond them."""
    if wide:
        return (col(a).cast(WIDE) * col(b).cast(WIDE)).cast(WIDE)
    return col(a) * col(b)


def int_div(a: str | Column, b: str | Column) -> Column:
    """Integer quotient truncated toward zero, as bigint; raises on a zero divisor."""
    return F.call_function("div", col(a), col(b))


def wide_div(a: str | Column, b: str | Column) -> Column:
    """Integer quotient of 38-digit operands. ``div`` would return a bigint and wrap,
    so the remainder is taken off first and the exact quotient cast back.
    """
    x, y = col(a).cast(WIDE), col(b).cast(WIDE)
    return ((x - x % y) / y).cast(WIDE)


def contains(c: str | Column, needle: str) -> Column:
    """Literal substring test (``%`` and ``_`` stay literal); reaches the Parquet scan as StringContains."""
    return col(c).contains(needle)


def not_contains(c: str | Column, needle: str) -> Column:
    return ~col(c).contains(needle)


def is_in(c: str | Column, values: Iterable[Any]) -> Column:
    return col(c).isin(list(values))


def case_when(cond: Column, then: Any, otherwise: Any) -> Column:
    return F.when(cond, then).otherwise(otherwise)


def regex_replace(c: str | Column, pattern: str, replacement: str) -> Column:
    """Replace every match; groups in the replacement are ``$1``, the syntax Java's."""
    return F.regexp_replace(col(c), pattern, replacement)
