"""Parquet or row-group files to CSV: ``python -m tessera.cli.export --input DIR --output DIR``. An empty table exits with 1."""

from __future__ import annotations

import argparse

from tessera.session import get_session
from tessera.sources import read_rowgroups, write_csv


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("--input", required=True)
    p.add_argument("--output", required=True)
    p.add_argument("--single_file", action="store_true", help="one file, written by one task, instead of one a partition")
    p.add_argument("--format", choices=["parquet", "rowgroups"], default="parquet")
    a = p.parse_args(argv)
    spark = get_session("export")
    df = read_rowgroups(spark, a.input) if a.format == "rowgroups" else spark.read.parquet(a.input)
    if df.isEmpty():
        return 1
    write_csv(df, a.output, single_file=a.single_file)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
