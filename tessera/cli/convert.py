"""CSV and schema text to Parquet or row-group files: ``python -m tessera.cli.convert --input F --output DIR --schema F``."""

from __future__ import annotations

import argparse

from tessera.session import get_session
from tessera.sources import read_csv, read_schema, write_rowgroups


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("--input", required=True)
    p.add_argument("--output", required=True)
    p.add_argument("--schema", required=True)
    p.add_argument("--row_group_bytes", type=int, default=128 << 20, help="target size of a row group")
    p.add_argument("--rows_per_group", type=int, default=65536, help="rows of a row group, in row-group files only")
    p.add_argument("--rows_per_file", type=int, default=0, help="0: no bound")
    p.add_argument("--format", choices=["parquet", "rowgroups"], default="parquet")
    a = p.parse_args(argv)
    spark = get_session("convert")
    df = read_csv(spark, a.input, read_schema(spark, a.schema))
    if a.format == "rowgroups":
        write_rowgroups(df, a.output, a.rows_per_group, a.row_group_bytes)
        return 0
    writer = df.write.mode("overwrite")
    writer = writer.option("parquet.block.size", a.row_group_bytes)
    if a.rows_per_file:
        writer = writer.option("maxRecordsPerFile", a.rows_per_file)
    writer.parquet(a.output)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
