"""Semantics that differ from SQL defaults."""

import datetime as dt
from decimal import Decimal

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tessera.cli.gen import generate
from tessera.functions import avg_int, byte_length, distinct_count, int_div, minute_of, mul, regex_replace, shifted_sums, sum_exact, sum_limbs, trunc_minute, variable, wide_div
from tessera.operators import aggregate, filter_rows, global_aggregate, hconcat, top_k, values
from tessera.streaming import drain


def one(df):
    return tuple(df.first())


def test_integer_average_truncates_toward_zero(spark):
    df = values(spark, [(-7,), (0,)], "x bigint")
    assert one(global_aggregate(df, a=avg_int("x"))) == (-3,)
    assert one(global_aggregate(df.limit(0), a=avg_int("x"))) == (None,)


def test_sum_of_bigints_is_exact_beyond_64_bits(spark):
    df = values(spark, [(2**63 - 1,), (2**63 - 1,), (5,)], "x bigint")
    assert one(global_aggregate(df, s=sum_exact("x"))) == (Decimal(2**64 + 3),)
    assert one(global_aggregate(df, a=avg_int("x"))) == ((2**64 + 3) // 3,)


def test_wide_division_does_not_wrap(spark):
    df = values(spark, [(Decimal(2**64 - 2), 1)], "a decimal(38,0), b bigint")
    assert one(df.select(wide_div("a", "b"))) == (Decimal(2**64 - 2),)
    assert one(df.select(mul("a", "a", wide=True))) == (Decimal((2**64 - 2) ** 2),) if (2**64 - 2) ** 2 < 10**38 else True


def test_division_by_zero_raises(spark):
    with pytest.raises(Exception, match="DIVIDE_BY_ZERO"):
        values(spark, [(1, 0)], "a bigint, b bigint").select(int_div("a", "b")).collect()


def test_length_is_in_bytes(spark):
    assert one(values(spark, [("й",)], "s string").select(byte_length("s"))) == (2,)


def test_minutes_floor_before_the_epoch(spark):
    rows = [(dt.datetime(1969, 12, 31, 23, 59, 59),), (dt.datetime(1970, 1, 1, 1, 45),)]
    out = values(spark, rows, "t timestamp_ntz").select(minute_of("t"), trunc_minute("t")).collect()
    assert [tuple(r) for r in out] == [(59, dt.datetime(1969, 12, 31, 23, 59)), (45, dt.datetime(1970, 1, 1, 1, 45))]


def test_regex_replaces_all(spark):
    assert one(values(spark, [("a b c",)], "s string").select(regex_replace("s", " ", "_"))) == ("a_b_c",)


def test_grouped_and_ungrouped(spark):
    df = values(spark, [(1,), (2,), (2,), (3,)], "u bigint")
    assert one(global_aggregate(df, s=sum_exact("u"), d=distinct_count("u"))) == (8, 3)
    assert one(aggregate(df.limit(0), [], n=F.count(F.lit(1)))) == (0,)


def test_shifted_sums_with_nulls(spark):
    df = values(spark, [(1,), (None,), (4,)], "x int")
    assert one(shifted_sums(df, "x", [0, 10])) == (5, 25)


def test_offset_is_applied(spark):
    assert [r[0] for r in top_k(spark.range(10), [F.desc("id")], 2, 3).collect()] == [6, 5]
    assert top_k(spark.range(10), ["id"], 0).collect() == []


def test_hconcat(spark):
    a, b = spark.range(3).select(F.col("id").alias("a")), spark.range(3).select((F.col("id") * -1).alias("b"))
    assert sorted(map(tuple, hconcat([a, b], [["a"], ["b"]]).collect())) == [(0, -2), (1, -1), (2, 0)]
    with pytest.raises(Exception, match="differ"):
        hconcat([a, b.limit(2)], [["a"], ["b"]]).collect()
    with pytest.raises(Exception, match="differ"):
        hconcat([a, b.limit(1)]).collect()


def test_variable_asserts_its_type(spark):
    with pytest.raises(TypeError):
        variable("id", spark.range(1), "string")


def test_generator(spark):
    assert [tuple(r) for r in generate(spark, 2, 1, 1).orderBy("f0").collect()] == [(0, "str1"), (2, "str3")]


def test_operators_accept_a_bounded_stream(spark, tmp_path):
    spark.range(10).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id bigint").parquet(str(tmp_path / "in"))
    out = drain(aggregate(filter_rows(stream, F.col("id") > 4), [], n=F.count(F.lit(1))), "drained", "complete")
    assert one(out) == (5,)


def test_sum_of_limbs_is_exact(spark):
    ends = [2**63 - 1, -(2**63), 5, -7, None, 2**63 - 1, 2**63 - 1]
    df = values(spark, [(x,) for x in ends], "x bigint")
    assert one(df.select(sum_limbs("x"))) == (Decimal(sum(x for x in ends if x is not None)),)
    assert one(df.filter("x is null").select(sum_limbs("x"))) == (None,)


def test_hconcat_keeps_columns_of_its_own_names(spark):
    a, b = values(spark, [(1, 2)], "_row int, _n1 int"), values(spark, [(3,)], "__row int")
    assert tuple(hconcat([a, b]).first()) == (1, 2, 3)


def test_row_groups_are_skipped_by_their_statistics(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(0, 400_000, numPartitions=1).selectExpr("id", "cast(id as string) as s").write.option("parquet.block.size", 256 << 10).parquet(path)
    file = next((tmp_path / "t").glob("*.parquet"))
    meta = pq.ParquetFile(file).metadata
    assert meta.num_row_groups > 3 and meta.num_rows == 400_000
    bounds = [meta.row_group(i).column(0).statistics for i in range(meta.num_row_groups)]
    assert bounds[0].min == 0 and bounds[-1].max == 399_999 and all(a.max < b.min for a, b in zip(bounds, bounds[1:]))  # noqa: B905
    df = spark.read.parquet(path).filter("id = 7")
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    while plan.children().nonEmpty():
        plan = plan.children().head()
    if plan.nodeName() == "AdaptiveSparkPlan":
        plan = plan.executedPlan()
    assert plan.metrics().get("numOutputRows").get().value() < 400_000
