"""Relational operators: pure ``DataFrame -> DataFrame`` functions."""

from tessera.operators.relational import (
    aggregate,
    count_table,
    filter_rows,
    global_aggregate,
    group_by_dependent,
    hconcat,
    limit_rows,
    project,
    scan,
    sort,
    top_k,
    values,
)

__all__ = [
    "aggregate", "count_table", "filter_rows", "global_aggregate", "group_by_dependent", "hconcat", "limit_rows",
    "project", "scan", "sort", "top_k", "values",
]
