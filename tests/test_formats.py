"""The format queries against their SQL twins."""

import duckdb
import pytest

import __spark_entry__ as entry
from tessera.plans import formats


@pytest.mark.parametrize("name", list(formats.queries()))
def test_matches_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("lineitem", "orders"):
        con.execute(f"CREATE VIEW {t} AS FROM '{sf_dir}/{t}.parquet'")
    got, want = entry.queries()[name](spark, sf_dir), con.sql(entry.oracle_sql()[name])
    assert got.columns == want.columns
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())
