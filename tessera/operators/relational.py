"""Relational operators.

Each function only builds the logical plan. What an engine of its own would
schedule by hand (column pruning, row-group skipping, partial aggregation,
bounded top-k heaps, spilling) is left to Catalyst and Tungsten.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def scan(spark: SparkSession, path: str, columns: Sequence[str] | None = None, predicate: Column | None = None) -> DataFrame:
    """Read Parquet, only ``columns`` in that order. A missing column is an analysis error.

    ``predicate`` is pushed to the scan, which skips row groups by their min/max statistics,
    and then filters the rows that are left.
    """
    df = spark.read.parquet(path)
    if predicate is not None:
        df = df.filter(predicate)
    return df if columns is None else df.select(*columns)


def count_table(spark: SparkSession, path: str, name: str = "count") -> DataFrame:
    """Row count of a Parquet table. The scan's ReadSchema is empty, so only footers are read."""
    return spark.read.parquet(path).agg(F.count(F.lit(1)).alias(name))


def filter_rows(df: DataFrame, condition: Column) -> DataFrame:
    """Rows where ``condition`` is true; HAVING when placed above an aggregate."""
    return df.filter(condition)


def project(df: DataFrame, **named: Column | str) -> DataFrame:
    """Replace all columns by the named expressions."""
    return df.select(*[(F.col(e) if isinstance(e, str) else e).alias(n) for n, e in named.items()])


def global_aggregate(df: DataFrame, **aggs: Column) -> DataFrame:
    """Aggregates over all rows; always one row. On no rows counts are 0, the rest null."""
    return df.agg(*[e.alias(n) for n, e in aggs.items()])


def aggregate(df: DataFrame, keys: Sequence[str] | Mapping[str, Column], **aggs: Column) -> DataFrame:
    """Hash GROUP BY; keys first, then aggregates. ``keys`` may be computed expressions."""
    if not keys:
        return global_aggregate(df, **aggs)
    by = [e.alias(n) for n, e in keys.items()] if isinstance(keys, Mapping) else [F.col(k) for k in keys]
    return df.groupBy(*by).agg(*[e.alias(n) for n, e in aggs.items()])


def group_by_dependent(df: DataFrame, key: str, dependent: Mapping[str, Column], **aggs: Column) -> DataFrame:
    """GROUP BY a key and functions of that key: groups by the key alone and adds the rest after,
    so that the hash key and the shuffled rows stay narrow. Catalyst doesn't infer such dependence.
    """
    out = aggregate(df, [key], **aggs)
    return out.select(key, *[e.alias(n) for n, e in dependent.items()], *aggs)


def _order(keys: Sequence[Column | str]) -> list[Column]:
    return [F.asc(k) if isinstance(k, str) else k for k in keys]


def sort(df: DataFrame, *keys: Column | str) -> DataFrame:
    """Total order by any expressions; strings sort ascending."""
    return df.orderBy(*_order(keys))


def top_k(df: DataFrame, keys: Sequence[Column | str], limit: int, offset: int = 0) -> DataFrame:
    """The ``limit`` best rows after the first ``offset``; a bounded heap per partition, then a merge.

    ``keys`` should be a total order, as ties are cut arbitrarily.
    """
    df = df.orderBy(*_order(keys))
    return (df.offset(offset) if offset else df).limit(limit)


def limit_rows(df: DataFrame, n: int) -> DataFrame:
    return df.limit(n)


def hconcat(frames: Sequence[DataFrame], order: Sequence[Sequence[str]] | None = None) -> DataFrame:
    """Glue frames side by side.

    Without ``order`` each frame must have one row. With ``order``, a list of sort keys per frame
    (DataFrames have no order of their own), row i of each frame meets row i of the others.
    Frames of unequal length raise when the result is computed.
    """
    if not frames:
        raise ValueError("hconcat needs at least one frame")
    if order is not None and len(order) != len(frames):
        raise ValueError("hconcat needs sort keys for every frame")
    taken = {c.lower() for f in frames for c in f.columns}
    number, *width = _fresh(taken, "row", *[f"n{i}" for i in range(len(frames))])
    out = None
    for i, frame in enumerate(frames):
        # row_number() over one window partition is a global numbering: it serves short frames such as results, and a second row
        # of a frame that should have one finds no partner elsewhere
        rank = F.row_number().over(Window.orderBy(*(order[i] if order else [F.lit(1)])))
        numbered = frame.withColumn(number, rank).withColumn(width[i], F.lit(1))
        out = numbered if out is None else out.join(numbered, number, "full_outer")
    unequal = F.lit(False)
    for name in width:
        unequal = unequal | F.col(name).isNull()
    checked = out.filter(F.when(unequal, F.raise_error(F.lit("hconcat: frames differ in their number of rows")).cast("boolean")).otherwise(True))
    return checked.drop(number, *width)


def _fresh(taken: set[str], *names: str) -> list[str]:
    """The names with as many underscores in front as none of ``taken`` has."""
    lead = "_"
    while any((lead + n).lower() in taken for n in names):
        lead += "_"
    return [lead + n for n in names]


def values(spark: SparkSession, rows: Sequence[Sequence[Any]], schema: StructType | str) -> DataFrame:
    """In-memory source."""
    return spark.createDataFrame([tuple(r) for r in rows], schema)
