"""Record borders of CSV by ranges, against the tokenizer on the whole text."""

import io
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.sources import csv_ranges, parse_records, parse_schema, read_csv
from tessera.sources.csv_ranges import RECORD, classes, effect, pieces, range_effect

TABLE = classes(",", '"', "\\")


def by_ranges(text, size):
    data, out, state = text.encode(), [], RECORD
    f = io.BytesIO(data)
    for begin in range(0, len(data), size):
        end = min(begin + size, len(data))
        after = range_effect(f, begin, end, TABLE)[state]
        for _, part in pieces(f, begin, end, state, after, TABLE):
            out += parse_records(part.decode())
        state = after
    return out


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet='ab,"\\\r\né', max_size=40), st.integers(1, 9), st.integers(1, 9), st.integers(1, 5))
def test_ranges_give_the_records_of_the_whole(text, size, piece, look):
    old = csv_ranges.PIECE, csv_ranges.LOOK
    csv_ranges.PIECE, csv_ranges.LOOK = piece, look
    try:
        try:
            want = list(parse_records(text))
        except ValueError:
            with pytest.raises(ValueError, match="unclosed"):
                by_ranges(text, size)
        else:
            assert by_ranges(text, size) == want
    finally:
        csv_ranges.PIECE, csv_ranges.LOOK = old


def test_effect_is_that_of_single_bytes():
    data = "".join(random.Random(3).choices('aaa,"\\\r\n', k=5000)).encode()
    states = list(range(8))
    for kind in data.translate(TABLE):
        states = [csv_ranges._step(s, kind) for s in states]
    assert effect(data, TABLE) == tuple(states) and effect(b"", TABLE) == tuple(range(8))


def test_large_files_are_read_in_several_tasks(spark, tmp_path):
    schema = parse_schema("a,int64\nb,string\n")
    rows = [(i, ['x"y', "line\nbreak", "a,b", "", "é" * 30][i % 5]) for i in range(3000)]
    body = "".join(f'{i},"{s.replace(chr(34), chr(34) * 2)}"\r\n' for i, s in rows)
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "large one.csv").write_bytes(body.encode())
    (tmp_path / "in" / "small.csv").write_text("9999,z\n")
    df = read_csv(spark, str(tmp_path / "in"), schema, split_bytes=4000)
    assert sorted(map(tuple, df.collect())) == [*rows, (9999, "z")]
    assert df.rdd.getNumPartitions() > len(body.encode()) // 4000
    for bad in ('1,"open\n', "1,2,3\n"):
        (tmp_path / "in" / "large one.csv").write_bytes((body + bad).encode())
        with pytest.raises(Exception, match="unclosed quote|3 fields"):
            read_csv(spark, str(tmp_path / "in"), schema, split_bytes=4000).collect()
