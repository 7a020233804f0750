"""Every query of the catalogue as a DataFrame plan; :mod:`tessera.plans.oracle` has the SQL twins.

Date bounds are written on the raw timestamp (``ts >= lo AND ts < hi + 1 day``), which reaches the
Parquet scan; a cast around the column would not.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import (
    avg_int,
    byte_length,
    case_when,
    const,
    contains,
    count_rows,
    distinct_count,
    int_div,
    is_in,
    maximum,
    minimum,
    minute_of,
    mul,
    negate,
    not_contains,
    regex_replace,
    shifted_sums,
    sum_exact,
    sum_limbs,
    trunc_minute,
)
from tessera.operators import (
    aggregate,
    count_table,
    filter_rows,
    global_aggregate,
    group_by_dependent,
    hconcat,
    project,
    scan,
    sort,
    top_k,
    values,
)
from tessera.plans.oracle import SQL

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

DOMAIN = r"^https?://(?:www\.)?([^/]+)/.*$"


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return scan(spark, f"{sf_dir}/{name}.parquet")


def c(name: str) -> Column:
    return F.col(name)


def days(name: str, first: str, last: str) -> Column:
    """``name`` within closed date bounds, in a form that is pushed down."""
    lo, hi = dt.datetime.fromisoformat(first), dt.datetime.fromisoformat(last) + dt.timedelta(days=1)
    return (c(name) >= F.lit(lo).cast("timestamp_ntz")) & (c(name) < F.lit(hi).cast("timestamp_ntz"))


@query
def q00(spark, d):
    return count_table(spark, f"{d}/lineitem.parquet")


@query
def q01(spark, d):
    return global_aggregate(filter_rows(table(spark, d, "lineitem"), c("l_linenumber") != 1), count=count_rows())


@query
def q02(spark, d):
    return global_aggregate(
        table(spark, d, "lineitem"), sum=sum_exact("l_linenumber", wide=False), count=count_rows(), total=avg_int("l_linenumber", sum_exact("l_linenumber", wide=False))
    )


@query
def q03(spark, d):
    return global_aggregate(table(spark, d, "lineitem"), total=avg_int("l_orderkey"))


@query
def q04(spark, d):
    return global_aggregate(table(spark, d, "lineitem"), distinct=distinct_count("l_orderkey"))


@query
def q05(spark, d):
    return global_aggregate(table(spark, d, "part"), distinct=distinct_count("p_name"))


@query
def q06(spark, d):
    ext = global_aggregate(table(spark, d, "lineitem"), min=minimum("l_shipdate"), max=maximum("l_shipdate"))
    return project(ext, min=c("min").cast("date"), max=c("max").cast("date"))  # the cast is monotone, so two values suffice


@query
def q07(spark, d):
    rows = filter_rows(table(spark, d, "lineitem"), c("l_linenumber") != 1)
    return sort(aggregate(rows, ["l_linenumber"], count=count_rows()), F.desc("count"), "l_linenumber")


@query
def q08(spark, d):
    out = aggregate(table(spark, d, "lineitem"), ["l_suppkey"], u=distinct_count("l_orderkey"))
    return top_k(out, [F.desc("u"), "l_suppkey"], 10)


@query
def q09(spark, d):
    out = aggregate(
        table(spark, d, "lineitem"), ["l_suppkey"],
        sum_adv=sum_exact("l_linenumber", wide=False), c=count_rows(), distinct_u=distinct_count("l_orderkey"),
    )
    best = top_k(out, [F.desc("c"), "l_suppkey"], 10)
    return project(best, l_suppkey="l_suppkey", sum_adv="sum_adv", c="c", avg_res=int_div("sum_adv", "c"), distinct_u="distinct_u")


@query
def q10(spark, d):
    rows = filter_rows(table(spark, d, "events"), c("event_type") != "error")
    return top_k(aggregate(rows, ["event_type"], u=distinct_count("user_id")), [F.desc("u"), "event_type"], 10)


@query
def q11(spark, d):
    rows = filter_rows(table(spark, d, "lineitem"), c("l_returnflag") != "N")
    out = aggregate(rows, ["l_linenumber", "l_returnflag"], u=distinct_count("l_orderkey"))
    return top_k(out, [F.desc("u"), "l_linenumber", "l_returnflag"], 10)


@query
def q12(spark, d):
    rows = filter_rows(table(spark, d, "part"), c("p_name") != "")
    return top_k(aggregate(rows, ["p_name"], c=count_rows()), [F.desc("c"), "p_name"], 10)


@query
def q13(spark, d):
    rows = filter_rows(table(spark, d, "events"), c("props") != "")
    return top_k(aggregate(rows, ["props"], u=distinct_count("user_id")), [F.desc("u"), "props"], 10)


@query
def q14(spark, d):
    rows = filter_rows(table(spark, d, "lineitem"), c("l_returnflag") != "N")
    out = aggregate(rows, ["l_suppkey", "l_returnflag"], c=count_rows())
    return top_k(out, [F.desc("c"), "l_suppkey", "l_returnflag"], 10)


@query
def q15(spark, d):
    return top_k(aggregate(table(spark, d, "events"), ["user_id"], c=count_rows()), [F.desc("c"), "user_id"], 10)


@query
def q16(spark, d):
    out = aggregate(table(spark, d, "events"), ["user_id", "event_type"], c=count_rows())
    return top_k(out, [F.desc("c"), "user_id", "event_type"], 10)


@query
def q17(spark, d):
    out = aggregate(table(spark, d, "events"), ["user_id", "event_type"], c=count_rows())
    return top_k(out, ["user_id", "event_type"], 10)


@query
def q18(spark, d):
    keys = {"user_id": c("user_id"), "m": minute_of("ts"), "event_type": c("event_type")}
    out = aggregate(table(spark, d, "events"), keys, c=count_rows())
    return top_k(out, [F.desc("c"), "user_id", "m", "event_type"], 10)


@query
def q19(spark, d):
    return scan(spark, f"{d}/lineitem.parquet", ["l_orderkey"], c("l_orderkey") == 201)


@query
def q20(spark, d):
    return global_aggregate(filter_rows(table(spark, d, "pages"), contains("url", "utm_source")), c=count_rows())


@query
def q21(spark, d):
    rows = filter_rows(table(spark, d, "documents"), contains("text", "ing") & (c("source") != ""))
    return top_k(aggregate(rows, ["source"], min_url=minimum("text"), c=count_rows()), [F.desc("c"), "source"], 10)


@query
def q22(spark, d):
    keep = contains("text", "th") & not_contains("text", "http") & (c("source") != "")
    out = aggregate(
        filter_rows(table(spark, d, "documents"), keep), ["source"],
        min_url=minimum("text"), min_title=minimum("lang"), c=count_rows(), distinct_u=distinct_count("doc_id"),
    )
    return top_k(out, [F.desc("c"), "source"], 10)


@query
def q23(spark, d):
    rows = filter_rows(table(spark, d, "events"), contains("props", "7")).select("event_id", "ts", "event_type", "props")
    return top_k(rows, ["ts", "event_id"], 10)


@query
def q24(spark, d):
    rows = filter_rows(table(spark, d, "events"), c("event_type") != "error")
    return top_k(rows, ["ts", "event_id"], 10).select("event_type", "ts")


@query
def q25(spark, d):
    return top_k(filter_rows(table(spark, d, "part"), c("p_name") != "").select("p_name"), ["p_name"], 10)


@query
def q26(spark, d):
    rows = filter_rows(table(spark, d, "events"), c("event_type") != "error").select("event_type", "ts")
    return top_k(rows, ["ts", "event_type"], 10)


@query
def q27(spark, d):
    rows = filter_rows(table(spark, d, "documents"), c("text") != "")
    out = filter_rows(aggregate(rows, ["lang"], l=avg_int(byte_length("text")), c=count_rows()), c("c") > 10)
    return top_k(out, [F.desc("l"), "lang"], 25)


@query
def q28(spark, d):
    rows = filter_rows(table(spark, d, "pages"), c("url") != "")
    keys = {"k": regex_replace("url", DOMAIN, "$1")}
    out = aggregate(rows, keys, l=avg_int(byte_length("url")), c=count_rows(), min_ref=minimum("url"))
    return top_k(filter_rows(out, c("c") >= 1), [F.desc("l"), "k"], 25)


@query
def q29(spark, d):
    return shifted_sums(table(spark, d, "part"), "p_size", range(90))


def _refresh(rows: DataFrame, keys: list[str], summed: Column) -> DataFrame:
    out = aggregate(rows, keys, c=count_rows(), sum_refresh=summed.cast("bigint"), avg_width=avg_int("l_partkey", sum_limbs("l_partkey")))
    return top_k(out, [F.desc("c"), *keys], 10)


@query
def q30(spark, d):
    return _refresh(filter_rows(table(spark, d, "lineitem"), c("l_returnflag") != "N"), ["l_linenumber", "l_suppkey"], sum_limbs("l_partkey"))


@query
def q31(spark, d):
    return _refresh(filter_rows(table(spark, d, "lineitem"), c("l_returnflag") != "N"), ["l_orderkey", "l_suppkey"], sum_exact("l_linenumber", wide=False))


@query
def q32(spark, d):
    return _refresh(table(spark, d, "lineitem"), ["l_orderkey", "l_suppkey"], sum_exact("l_linenumber", wide=False))


@query
def q33(spark, d):
    return top_k(aggregate(table(spark, d, "part"), ["p_type"], c=count_rows()), [F.desc("c"), "p_type"], 10)


@query
def q34(spark, d):
    out = aggregate(table(spark, d, "part"), {"const_1": const(1, "bigint"), "p_type": c("p_type")}, c=count_rows())
    return top_k(out, [F.desc("c"), "p_type"], 10)


@query
def q35(spark, d):
    dependent = {f"p_size_{k}": c("p_size") - k for k in (1, 2, 3)}
    return top_k(group_by_dependent(table(spark, d, "part"), "p_size", dependent, c=count_rows()), [F.desc("c"), "p_size"], 10)


def _views(spark, d, first, last, keys, keep=None, limit=10, offset=0) -> DataFrame:
    cond = (c("l_suppkey") == 7) & days("l_shipdate", first, last)
    rows = filter_rows(table(spark, d, "lineitem"), cond if keep is None else cond & keep)
    out = aggregate(rows, keys, PageViews=count_rows())
    return top_k(out, [F.desc("PageViews"), *keys], limit, offset)


@query
def q36(spark, d):
    keep = (c("l_linenumber") != 7) & (c("l_linestatus") == "O") & (c("l_returnflag") != "")
    return _views(spark, d, "1996-01-01", "1997-12-31", ["l_partkey"], keep)


@query
def q37(spark, d):
    return _views(spark, d, "1996-01-01", "1997-12-31", ["l_returnflag"], (c("l_linestatus") == "O") & (c("l_returnflag") != ""))


@query
def q38(spark, d):
    return _views(spark, d, "1996-01-01", "1998-12-31", ["l_partkey"], c("l_linenumber") != 0, offset=20)


@query
def q39(spark, d):
    src = case_when((c("l_linenumber") == 1) & (c("l_returnflag") == "N"), c("l_linestatus"), "")
    keys = {"l_linenumber": c("l_linenumber"), "l_returnflag": c("l_returnflag"), "src": src, "dst": c("l_partkey")}
    return _views(spark, d, "1996-01-01", "1998-12-31", keys, offset=20)


@query
def q40(spark, d):
    keys = {"l_partkey": c("l_partkey"), "d": c("l_shipdate").cast("date")}
    return _views(spark, d, "1996-01-01", "1998-12-31", keys, is_in("l_linenumber", [-1, 6]), offset=5)


@query
def q41(spark, d):
    rows = filter_rows(table(spark, d, "part"), c("p_type") == "ECONOMY")
    out = aggregate(rows, ["p_size", "p_brand"], PageViews=count_rows())
    return top_k(out, [F.desc("PageViews"), "p_size", "p_brand"], 10, 10)


@query
def q42(spark, d):
    rows = filter_rows(table(spark, d, "events"), days("ts", "2024-01-10", "2024-01-20") & (c("event_type") != "error"))
    return top_k(aggregate(rows, {"m": trunc_minute("ts")}, PageViews=count_rows()), ["m"], 10, 100)


@query
def f_not(spark, d):
    rows = filter_rows(table(spark, d, "lineitem"), negate((c("l_linenumber") < 3) | (c("l_returnflag") == "N")))
    return global_aggregate(rows, c=count_rows())


@query
def f_cmp(spark, d):
    x = c("l_linenumber")
    tests = {"lt": x < 3, "le": x <= 3, "gt": x > 3, "ge": x >= 3, "eq": x == 3, "ne": x != 3}
    return global_aggregate(table(spark, d, "lineitem"), **{k: F.count_if(t) for k, t in tests.items()})


@query
def f_arith(spark, d):
    o, p = c("l_orderkey"), c("l_partkey")
    rows = filter_rows(table(spark, d, "lineitem"), o <= 50)
    return project(rows, l_orderkey=o, l_linenumber="l_linenumber", a=o + p, s=o - p, m=mul(o, p), d=int_div(p - o, F.lit(7)))


@query
def f_strlen(spark, d):
    return project(table(spark, d, "documents"), doc_id="doc_id", bytes=byte_length("text"))


@query
def f_contains_literal(spark, d):
    return global_aggregate(
        table(spark, d, "pages"), q=F.count_if(contains("url", "?")), n=F.count_if(not_contains("url", "page="))
    )


@query
def f_regex_all(spark, d):
    return project(table(spark, d, "pages"), page_id="page_id", u=regex_replace("url", "[0-9]+", "#"))


@query
def f_minute(spark, d):
    return project(table(spark, d, "events"), event_id="event_id", m=minute_of("ts"), t=trunc_minute("ts"))


@query
def f_case(spark, d):
    src = case_when(c("o_orderstatus") == "F", c("o_orderpriority"), "")
    return project(table(spark, d, "orders"), o_orderkey="o_orderkey", src=src)


@query
def a_minmax_types(spark, d):
    rows = table(spark, d, "lineitem")
    return global_aggregate(
        rows, mn_i32=minimum("l_linenumber"), mx_i64=maximum("l_orderkey"), mn_s=minimum("l_returnflag"),
        mx_d=maximum(c("l_shipdate").cast("date")), mx_ts=maximum("l_shipdate"), mn_b=minimum(c("l_linenumber") > 3),
    )


@query
def a_sum_wide(spark, d):
    return global_aggregate(table(spark, d, "lineitem"), s=sum_exact(mul("l_orderkey", const(1000000007), wide=True)))


@query
def a_distinct_types(spark, d):
    return global_aggregate(
        table(spark, d, "lineitem"), d_ts=distinct_count("l_shipdate"), d_s=distinct_count("l_returnflag"),
        d_d=distinct_count(c("l_shipdate").cast("date")),
    )


@query
def o_hconcat(spark, d):
    a = global_aggregate(table(spark, d, "lineitem"), sum_lines=sum_exact("l_linenumber", wide=False))
    return hconcat([a, count_table(spark, f"{d}/orders.parquet", "n_orders")])


@query
def o_sort_full(spark, d):
    return sort(table(spark, d, "orders").select("o_orderkey", "o_orderstatus"), F.desc("o_orderstatus"), "o_orderkey")


@query
def o_scan_prune(spark, d):
    return scan(spark, f"{d}/lineitem.parquet", ["l_orderkey", "l_returnflag"], c("l_orderkey").between(10, 20))


@query
def o_values(spark, d):
    return values(spark, [(1, "abc"), (2, "qwe"), (3, "def")], "a bigint, c string")


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
