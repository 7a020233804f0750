"""Round trips through the file formats as queries with SQL twins: each writes whole tables and reads them back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.plans.catalog import Query
from tessera.sources import parse_schema, read_csv, read_rowgroups, write_csv, write_rowgroups
from tessera.sources.store import shared_dir


def io_rowgroups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines through row-group files: 64-bit and 32-bit integers, strings, timestamps."""
    path = f"{shared_dir(spark)}/rowgroups-{uuid.uuid4().hex}"
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    write_rowgroups(lines.select("l_orderkey", "l_linenumber", "l_returnflag", F.col("l_shipdate").cast("timestamp_ntz")), path)
    return read_rowgroups(spark, path)


def io_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders through CSV whose fields hold quotes, commas and line breaks, read in ranges of 1 MB."""
    path = f"{shared_dir(spark)}/csv-{uuid.uuid4().hex}"
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    note = F.concat(F.lit('"'), "o_orderpriority", F.lit(",\n"), "o_orderstatus")
    write_csv(orders.select("o_orderkey", "o_custkey", "o_orderstatus", note.alias("note")), path)
    schema = parse_schema("o_orderkey,int64\no_custkey,int64\no_orderstatus,string\nnote,string\n")
    return read_csv(spark, path, schema, split_bytes=1 << 20)


def queries() -> dict[str, Query]:
    return {"io_rowgroups": io_rowgroups, "io_csv": io_csv}


def oracle_sql() -> dict[str, str]:
    return {
        "io_rowgroups": "SELECT l_orderkey, l_linenumber, l_returnflag, l_shipdate FROM lineitem",
        "io_csv": """SELECT o_orderkey, o_custkey, o_orderstatus, '"' || o_orderpriority || ',' || chr(10) || o_orderstatus AS note FROM orders""",
    }
