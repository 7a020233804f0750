"""Synthetic tables: int64 columns, then string columns; cell (i, j) is ``i * columns + j``."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import get_session
from tessera.sources import write_csv, write_schema


def generate(spark: SparkSession, rows: int, ints: int = 1, strings: int = 1) -> DataFrame:
    n = ints + strings
    cell = [F.col("id") * n + j for j in range(n)]
    return spark.range(rows).select(
        *[cell[j].alias(f"f{j}") for j in range(ints)],
        *[F.concat(F.lit("str"), cell[j].cast("string")).alias(f"f{j}") for j in range(ints, n)],
    )


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("--rows", type=int, default=100)
    p.add_argument("--ints", type=int, default=1)
    p.add_argument("--strings", type=int, default=1)
    p.add_argument("--schema")
    p.add_argument("--parquet")
    p.add_argument("--csv")
    a = p.parse_args(argv)
    spark = get_session("gen")
    df = generate(spark, a.rows, a.ints, a.strings)
    if a.schema:
        write_schema(spark, df.schema, a.schema)
    if a.parquet:
        df.write.mode("overwrite").parquet(a.parquet)
    if a.csv:
        write_csv(df, a.csv, single_file=True)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
