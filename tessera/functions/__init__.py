"""Scalar expressions and aggregates."""

from tessera.functions.aggregates import (
    avg_int,
    count_rows,
    distinct_count,
    maximum,
    minimum,
    shifted_sums,
    sum_exact,
    sum_limbs,
)
from tessera.functions.scalar import (
    add,
    byte_length,
    case_when,
    const,
    contains,
    int_div,
    is_in,
    minute_of,
    mul,
    negate,
    not_contains,
    regex_replace,
    sub,
    trunc_minute,
    variable,
    wide_div,
)

__all__ = [
    "add", "avg_int", "byte_length", "case_when", "const", "contains", "count_rows", "distinct_count", "int_div", "is_in",
    "maximum", "minimum", "minute_of", "mul", "negate", "not_contains", "regex_replace", "shifted_sums", "sub",
    "sum_exact", "sum_limbs", "trunc_minute", "variable", "wide_div",
]
