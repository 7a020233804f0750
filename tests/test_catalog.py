"""Each catalogue query against its SQL twin, and the shapes of plans."""

import duckdb
import pytest

from tessera.plans import oracle_sql, queries

TABLES = "region nation customer supplier part orders lineitem events documents pages".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS FROM '{sf_dir}/{t}.parquet'")
    return con


def test_every_query_has_a_twin():
    assert queries().keys() == oracle_sql().keys() and len(queries()) == 58


@pytest.mark.parametrize("name", list(queries()))
def test_matches_oracle(spark, duck, sf_dir, name):
    got, want = queries()[name](spark, sf_dir), duck.sql(oracle_sql()[name])
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    key = lambda rows: sorted(repr(tuple(r[c] for c in cols)) for r in rows)
    assert key(r.asDict() for r in got.collect()) == key(dict(zip(want.columns, r, strict=True)) for r in want.fetchall())


def plan(df):
    return df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


def test_point_lookup_is_pushed_and_pruned(spark, sf_dir):
    text = plan(queries()["q19"](spark, sf_dir))
    assert "EqualTo(l_orderkey,201)" in text and "ReadSchema: struct<l_orderkey:bigint>" in text


def test_date_bounds_are_pushed(spark, sf_dir):
    assert "GreaterThanOrEqual(l_shipdate" in plan(queries()["q36"](spark, sf_dir))


def test_count_reads_no_column(spark, sf_dir):
    assert "ReadSchema: struct<>" in plan(queries()["q00"](spark, sf_dir))


def test_top_k_is_bounded(spark, sf_dir):
    assert "TakeOrderedAndProject" in plan(queries()["q38"](spark, sf_dir))


def test_constant_key_is_dropped(spark, sf_dir):
    assert "Keys [1]: [p_type" in plan(queries()["q34"](spark, sf_dir))
