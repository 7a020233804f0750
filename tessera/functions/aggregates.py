"""Aggregates. All support partial aggregation, so they combine before the shuffle."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.scalar import WIDE, col, int_div


def count_rows() -> Column:
    """Rows, whatever they hold."""
    return F.count(F.lit(1))


def sum_exact(c: str | Column, wide: bool = True) -> Column:
    """Exact sum. ``wide`` accumulates in 38 digits (for bigint and decimal input);
    otherwise Spark's own widening holds: smallint and int give a bigint that raises on overflow.
    """
    return F.sum(col(c).cast(WIDE)) if wide else F.sum(col(c))


def sum_limbs(c: str | Column) -> Column:
    """Exact sum of integers of up to 64 bits in 38 digits, from the sums of their high and low 32 bits.

    For many small groups: both are plain bigint sums, without a decimal per row. A group of fewer than 2**31 rows can't
    overflow them, a larger one may raise in ANSI mode; :func:`sum_exact` has no such bound.
    """
    x = col(c).cast("bigint")
    high, low = F.sum(F.shiftright(x, 32)), F.sum(x.bitwiseAND(F.lit(0xFFFFFFFF).cast("bigint")))
    return (high.cast(WIDE) * F.lit(1 << 32).cast("decimal(20,0)") + low.cast(WIDE)).cast(WIDE)


def distinct_count(c: str | Column) -> Column:
    """Exact distinct count."""
    return F.count_distinct(col(c))


def minimum(c: str | Column) -> Column:
    return F.min(col(c))


def maximum(c: str | Column) -> Column:
    return F.max(col(c))


def avg_int(c: str | Column, total: Column | None = None) -> Column:
    """Integer average: exact sum (``total``, if given) ``div`` count of non-null values, truncated toward zero.

    The quotient of a sum of bigints by their count fits a bigint, so ``div`` is safe on the wide sum. Null for an empty group.
    """
    n = F.count(col(c))
    return int_div(sum_exact(c) if total is None else total, F.when(n > 0, n))


def shifted_sums(df: DataFrame, c: str, shifts: Sequence[int], prefix: str = "s") -> DataFrame:
    """``sum(c + k)`` for every ``k``, from one sum and one count.

    ``sum(c + k) = sum(c) + k * count(c)``: two accumulators instead of ``len(shifts)``. An empty
    input gives nulls, as the sums themselves would.
    """
    base = df.agg(F.sum(F.col(c).cast(WIDE)).alias("_sum"), F.count(c).alias("_n"))
    return base.selectExpr(*[f"cast(_sum + {int(k)} * cast(_n as decimal(20,0)) as bigint) as `{prefix}{k}`" for k in shifts])
