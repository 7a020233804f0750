"""Schema text, the CSV dialect, text forms and the command lines."""

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.cli import convert, export, run_queries
from tessera.cli.run_queries import parse_query_list, should_run
from tessera.operators import values
from tessera.sources import format_schema, parse_date, parse_records, parse_schema, parse_timestamp, read_csv, to_text, write_csv


def test_schema_round_trip():
    text = "a,int64\nb,string\nc,char\nd,int128\ne,bool\nf,date\ng,timestamp\nh,int16\ni,int32\n"
    assert format_schema(parse_schema(text)) == text
    assert parse_schema("WatchID,int64,\n").names == ["WatchID"]
    with pytest.raises(ValueError, match="unknown type"):
        parse_schema("a,float\n")


@pytest.mark.parametrize(
    ("text", "rows"),
    [
        ("", []),
        (",b,\n,,\n", [["", "b", ""], ["", "", ""]]),
        ('"a,b",c\n', [["a,b", "c"]]),
        ('"say ""hi""",x', [['say "hi"', "x"]]),
        (r'"a\nb",a\,b' + "\n", [["a\nb", "a,b"]]),
        ('"x\r\ny",1\r2,3\n', [["x\ny", "1"], ["2", "3"]]),
        ('a"b,c\n', [['a"b', "c"]]),
        ("a\n\nb", [["a"], [""], ["b"]]),
        ("a\\", [["a\\"]]),
    ],
)
def test_dialect(text, rows):
    assert list(parse_records(text)) == rows


def test_unclosed_quote():
    with pytest.raises(ValueError, match="line 2"):
        list(parse_records('a\n"b'))


SCHEMA = parse_schema("a,int64\nb,string\nd,date\nt,timestamp\n")
ROWS = [(1, "", dt.date(1969, 12, 31), dt.datetime(2020, 1, 2, 3, 4, 5, 120000)), (2, 'q",\n', dt.date(2013, 7, 15), dt.datetime(1970, 1, 1))]


@pytest.mark.parametrize("dialect", ["auto", "full"])
def test_csv_round_trip(spark, tmp_path, dialect):
    path = str(tmp_path / "csv")
    write_csv(values(spark, ROWS, SCHEMA), path, single_file=True)
    assert sorted(map(tuple, read_csv(spark, path, SCHEMA, dialect).collect())) == ROWS


def test_plain_and_width(spark, tmp_path):
    p = tmp_path / "x.csv"
    p.write_text("1,a\n2,\n")
    two = parse_schema("a,int64\nb,string\n")
    assert sorted(map(tuple, read_csv(spark, str(p), two).collect())) == [(1, "a"), (2, "")]
    p.write_text("1,a,z\n")
    for dialect in ("plain", "full"):
        with pytest.raises(Exception):  # noqa: B017
            read_csv(spark, str(p), two, dialect).collect()


@pytest.mark.parametrize("text", ["2023-1-1", "2023-02-29", "2023-13-01", "x"])
def test_bad_dates(spark, text):
    assert values(spark, [(text,)], "s string").select(parse_date("s", strict=False)).first()[0] is None


@pytest.mark.parametrize("text", ["2023-01-01", "2023-01-01 24:00:00", "2023-01-01 00:60:00", "2023-01-01 00:00:60"])
def test_bad_timestamps(spark, text):
    assert values(spark, [(text,)], "s string").select(parse_timestamp("s", strict=False)).first()[0] is None


def test_text_forms(spark):
    df = values(spark, [(True, dt.datetime(2020, 1, 1, 0, 0, 0, 120000), dt.datetime(2020, 1, 1), Decimal(-5))], "b boolean, t timestamp_ntz, u timestamp_ntz, d decimal(38,0)")
    out = df.select(*[to_text(F.col(f.name), f.dataType) for f in df.schema.fields]).first()
    assert tuple(out) == ("1", "2020-01-01 00:00:00.120000", "2020-01-01 00:00:00", "-5")
    got = values(spark, [("2020-01-01T00:00:00.123456789",)], "s string").select(parse_timestamp("s")).first()[0]
    assert got == dt.datetime(2020, 1, 1, 0, 0, 0, 123456)


def test_selection_rules():
    assert parse_query_list(" q1, Q2,3,x,") == {1, 2, 3}
    assert not should_run(1, {1}, {1}) and should_run(5, {5}, set(), 0, 2)
    assert [i for i in range(5) if should_run(i, set(), set(), 1, 3)] == [1, 2, 3]


def test_command_lines(spark, tmp_path, sf_dir):
    (tmp_path / "s").write_text("a,int64\nb,string\n")
    (tmp_path / "in.csv").write_text('1,"x,y"\n2,z\n')
    assert convert.main(["--input", str(tmp_path / "in.csv"), "--schema", str(tmp_path / "s"), "--output", str(tmp_path / "p")]) == 0
    assert export.main(["--input", str(tmp_path / "p"), "--output", str(tmp_path / "out")]) == 0
    assert sorted(next((tmp_path / "out").glob("part-*")).read_text().splitlines()) == ['1,"x,y"', "2,z"]
    assert run_queries.main(["--input", sf_dir, "--output_dir", str(tmp_path / "q"), "--queries", "1,6"]) == 0
    assert {p.name for p in (tmp_path / "q").iterdir()} == {"q1.csv", "q6.csv"}


def test_parquet_round_trip(spark, tmp_path):
    schema = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.StringType())])
    for part in ([(1, "x"), (2, "y")], [(3, "z")]):
        values(spark, part, schema).write.mode("append").parquet(str(tmp_path / "t"))
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "t")).collect())) == [(1, "x"), (2, "y"), (3, "z")]
