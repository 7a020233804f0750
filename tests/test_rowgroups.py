"""The row-group format: its bytes, round trips, zone maps, columns, damage."""

import datetime as dt
import struct
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tessera.cli import convert, export
from tessera.operators import values
from tessera.sources import parse_schema, read_rowgroups, write_rowgroups
from tessera.sources.rowgroups import RowGroups, read_footer

ALL = parse_schema("a,bool\nb,int16\nc,int32\nd,int64\ne,int128\nf,date\ng,timestamp\nh,char\ni,string\n")
ROWS = [
    (True, -2, 3, 1 << 40, Decimal(10**37), dt.date(1969, 12, 31), dt.datetime(2020, 1, 2, 3, 4, 5, 6), "x", "é"),
    (False, 7, -3, -5, Decimal(-1), dt.date(2024, 2, 29), dt.datetime(1969, 12, 31, 23, 59, 59), "y", ""),
    (True, 0, 0, 0, Decimal(0), dt.date(1970, 1, 1), dt.datetime(1970, 1, 1), "z", 'q",\n'),
]


def q(*xs):
    return struct.pack(f"<{len(xs)}q", *xs)


def blob(b):
    return q(len(b)) + b


def by_hand(zones=True):
    """Two groups of (n int64, s string): (1, "ab"), (2, "") and (9, "z")."""
    one = q(2) + q(24, 48) + q(2, 1, 2) + q(2) + blob(b"ab") + blob(b"")
    two = q(1) + q(24, 40) + q(1, 9) + q(1) + blob(b"z")
    meta = blob(b"n,int64\ns,string\n") + q(2, 0, len(one), 2, 1)
    if zones:
        z = [((1, 2), (b"", b"ab")), ((9, 9), (b"z", b"z"))]
        parts = [q(2) + blob(b"\x01\x03\x00" + q(*n)) + blob(b"\x01\x08\x00" + blob(s[0]) + blob(s[1])) for n, s in z]
        meta += q(2) + b"".join(map(blob, parts))
    meta = blob(meta)
    return one + two + meta + q(len(meta), 0x434C4D4E52524734)


@pytest.mark.parametrize("zones", [True, False])
def test_bytes_are_read(spark, tmp_path, zones):
    (tmp_path / "t.rg").write_bytes(by_hand(zones))
    df = read_rowgroups(spark, str(tmp_path / "t.rg"))
    assert sorted(map(tuple, df.collect())) == [(1, "ab"), (2, ""), (9, "z")]
    assert [r.s for r in df.filter("n > 5").collect()] == ["z"]


def test_bytes_are_written(spark, tmp_path):
    df = values(spark, [(1, "ab"), (2, ""), (9, "z")], parse_schema("n,int64\ns,string\n")).coalesce(1)
    write_rowgroups(df, str(tmp_path / "t"), rows=2)
    (found,) = (tmp_path / "t").glob("*.rg")
    assert found.read_bytes() == by_hand()


def test_all_types_return(spark, tmp_path):
    path = str(tmp_path / "t")
    write_rowgroups(values(spark, ROWS, ALL), path, rows=2)
    df = read_rowgroups(spark, path)
    assert sorted(map(tuple, df.collect()), key=str) == sorted(ROWS, key=str)
    assert [f.metadata for f in df.schema.fields] == [f.metadata for f in ALL.fields]


def test_append_overwrite_and_hidden_files(spark, tmp_path):
    path, df = str(tmp_path / "t"), spark.range(10)
    write_rowgroups(df, path)
    write_rowgroups(df, path, mode="append")
    assert read_rowgroups(spark, path).count() == 20
    write_rowgroups(df, path)
    assert read_rowgroups(spark, path).count() == 10
    assert not list((tmp_path / "t").glob("_*"))


def test_empty_tables_and_columns(spark, tmp_path):
    path = str(tmp_path / "t")
    write_rowgroups(values(spark, [], ALL), path)
    assert read_rowgroups(spark, path).collect() == []
    write_rowgroups(values(spark, ROWS, ALL), path)
    df = read_rowgroups(spark, path, ["i", "b"])
    assert df.columns == ["i", "b"] and ("é", -2) in map(tuple, df.collect())
    assert df.groupBy().count().first()[0] == 3
    with pytest.raises(Exception, match="no column zz"):
        read_rowgroups(spark, path, ["zz"]).collect()
    (tmp_path / "none").mkdir()
    with pytest.raises(Exception, match="no file"):
        read_rowgroups(spark, str(tmp_path / "none")).collect()


FILTERS = [
    ("d = 650", 1), ("d > 899", 1), ("d >= 900 and d < 950", 1), ("d in (5, 995)", 2), ("d < 0", 0), ("d <= 99", 1), ("s = 'k0150'", 1),
    ("day > date'1972-06-01'", 2), ("t < timestamp_ntz'1970-01-01 00:00:00.0002'", 2), ("d = 1 or d = 999", 10), ("d != 5", 10),
]


@pytest.mark.parametrize(("condition", "groups"), FILTERS)
def test_zone_maps_leave_out_groups(spark, tmp_path, condition, groups):
    """Groups read are counted at the source; results equal those of the whole table filtered by Spark."""
    df = spark.range(1000).selectExpr("id d", "printf('k%04d', id) s", "date_add(date'1970-01-01', int(id)) day", "timestamp_micros(id)::timestamp_ntz t").coalesce(1)
    write_rowgroups(df, str(tmp_path / "t"), rows=100)
    found = read_rowgroups(spark, str(tmp_path / "t")).filter(condition).withColumn("g", F.expr("d div 100"))
    assert {r.d for r in found.collect()} == {r.d for r in df.filter(condition).collect()}
    source = RowGroups({"path": str(tmp_path / "t"), "pushdown": "true"})
    kept, reader = [], source.reader(source.schema())
    list(reader.pushFilters(_pushed(condition)))
    for p in reader.partitions():
        kept += p.groups
    assert len(kept) == groups


def _pushed(condition):
    from pyspark.sql.datasource import EqualTo, GreaterThan, GreaterThanOrEqual, In, LessThan, LessThanOrEqual

    return {
        "d = 650": [EqualTo(("d",), 650)],
        "d > 899": [GreaterThan(("d",), 899)],
        "d >= 900 and d < 950": [GreaterThanOrEqual(("d",), 900), LessThan(("d",), 950)],
        "d in (5, 995)": [In(("d",), (5, 995))],
        "d < 0": [LessThan(("d",), 0)],
        "d <= 99": [LessThanOrEqual(("d",), 99)],
        "s = 'k0150'": [EqualTo(("s",), "k0150")],
        "day > date'1972-06-01'": [GreaterThan(("day",), dt.date(1972, 6, 1))],
        "t < timestamp_ntz'1970-01-01 00:00:00.0002'": [LessThan(("t",), dt.datetime(1970, 1, 1, 0, 0, 0, 200))],
    }.get(condition, [])


def test_pushed_by_spark(spark, tmp_path):
    write_rowgroups(spark.range(1000).coalesce(1), str(tmp_path / "t"), rows=100)
    df = read_rowgroups(spark, str(tmp_path / "t"))
    assert df.filter("id = 650").rdd.getNumPartitions() == 1
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1")
    try:
        df = read_rowgroups(spark, str(tmp_path / "t"))
        assert (df.rdd.getNumPartitions(), df.filter("id >= 800").rdd.getNumPartitions()) == (10, 2)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_sessions_without_pushdown(spark, tmp_path):
    write_rowgroups(spark.range(1000).coalesce(1), str(tmp_path / "t"), rows=100)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "false")
    try:
        assert [r.id for r in read_rowgroups(spark, str(tmp_path / "t")).filter("id = 650").collect()] == [650]
        assert spark.read.format("rowgroups").option("path", str(tmp_path / "t")).load().filter("id < 5").count() == 5
    finally:
        spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def test_damage_and_nulls_raise(spark, tmp_path):
    whole = by_hand()
    for name, data in [("magic", whole[:-1] + b"x"), ("short", whole[:10]), ("rows", q(3) + whole[8:]), ("size", whole[:24] + q(7) + whole[32:])]:
        (tmp_path / name).write_bytes(data)
        with pytest.raises(Exception):  # noqa: B017
            read_rowgroups(spark, str(tmp_path / name)).collect()
    with pytest.raises(Exception, match="no nulls"):
        write_rowgroups(spark.sql("select cast(null as bigint) n"), str(tmp_path / "n"))
    with pytest.raises(Exception, match="has no name"):
        write_rowgroups(spark.sql("select 1.5d x"), str(tmp_path / "n"))
    assert read_footer(str(tmp_path / "rows"))[1][0].rows == 2


def test_command_lines(spark, tmp_path):
    (tmp_path / "s").write_text("a,int64\nb,string\n")
    (tmp_path / "in.csv").write_text('1,"x,y"\n2,z\n')
    to, back = ["--input", str(tmp_path / "in.csv"), "--schema", str(tmp_path / "s")], ["--input", str(tmp_path / "g"), "--format", "rowgroups"]
    assert convert.main([*to, "--output", str(tmp_path / "g"), "--format", "rowgroups", "--rows_per_group", "1"]) == 0
    assert sum(len(read_footer(str(p))[1]) for p in (tmp_path / "g").glob("*.rg")) == 2
    assert export.main([*back, "--output", str(tmp_path / "out")]) == 0
    assert sorted(next((tmp_path / "out").glob("part-*")).read_text().splitlines()) == ['1,"x,y"', "2,z"]
