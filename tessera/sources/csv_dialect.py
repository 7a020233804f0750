"""CSV in the engine's dialect: no header, doubled quotes and backslash escapes, any line end.

Spark's own CSV parser leaves ``\\n`` undecoded, splits an unquoted ``a\\,b`` and mis-splits mixed line
ends, so a file that holds a quote, a backslash, a carriage return or an empty line goes through
:func:`parse_records`: small files whole, larger ones by ranges of bytes (:mod:`tessera.sources.csv_ranges`),
which executors and driver open through ``pyarrow.fs``. Other files take the built-in reader.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.sources.csv_ranges import RECORD, classes, pieces, range_effect
from tessera.sources.store import open_store
from tessera.sources.text import parse_date, parse_timestamp, to_text

# What a backslash in front of these stands for; before others it is dropped.
ESCAPES = {"n": "\n", "r": "\r", "t": "\t"}


def parse_records(text: str, delimiter: str = ",", quote: str = '"', escape: str = "\\") -> Iterator[list[str]]:
    """Records of a text. A quote opens only at the start of a field; LF, CRLF and CR end records and
    become LF within quotes; an unclosed quote raises with the lines concerned.
    """
    plain = {delimiter, quote, escape, "\r", "\n"}
    row: list[str] = []
    field: list[str] = []
    quoted, any_char, line, began, i, n = False, False, 1, 1, 0, len(text)
    while i < n:
        ch = text[i]
        any_char = True
        if ch not in plain:
            j = i + 1
            while j < n and text[j] not in plain:
                j += 1
            field.append(text[i:j])
            i = j
            continue
        i += 1
        if ch in "\r\n":
            i += ch == "\r" and text[i : i + 1] == "\n"
            line += 1
            if quoted:
                field.append("\n")
                continue
            yield [*row, "".join(field)]
            row, field, any_char, began = [], [], False, line
        elif ch == escape:
            if i < n:
                field.append(ESCAPES.get(text[i], text[i]))
                i += 1
            else:
                field.append(ch)
        elif ch == quote and quoted:
            if text[i : i + 1] == quote:
                field.append(quote)
                i += 1
            else:
                quoted = False
        elif ch == quote and not any(field):
            quoted = True
        elif ch == delimiter and not quoted:
            row.append("".join(field))
            field = []
        else:
            field.append(ch)
    if quoted:
        raise ValueError(f"unclosed quote: record began at line {began}, text ended at line {line}")
    if any_char:
        yield [*row, "".join(field)]


def _typed(df: DataFrame, schema: T.StructType) -> DataFrame:
    out = []
    for f in schema.fields:
        x = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.StringType):
            x = F.substring(x, 1, 1) if f.metadata.get("char") else x
        elif isinstance(f.dataType, T.DateType):
            x = parse_date(x)
        elif isinstance(f.dataType, T.TimestampNTZType):
            x = parse_timestamp(x)
        elif isinstance(f.dataType, T.BooleanType):
            raise ValueError(f"column {f.name}: bool has no CSV form to import")
        else:
            x = x.cast(f.dataType)
        out.append(x.alias(f.name))
    return df.select(*out)


def read_csv(spark: SparkSession, path: str, schema: T.StructType, dialect: str = "auto", split_bytes: int = 64 << 20) -> DataFrame:
    """Read CSV with an explicit schema. A record of another width, or a bad value, raises.

    ``dialect``: ``full`` for the tokenizer, ``plain`` for Spark's splittable reader, ``auto`` to choose
    by one scan of the lines. An empty field is the empty string. The tokenizer reads files of more than
    ``split_bytes`` in ranges of that size, each a task of its own, after a first pass over them.
    """
    if dialect == "auto":
        lines = spark.read.option("lineSep", "\n").text(path)
        odd = F.col("value").contains("\\") | F.col("value").contains("\r") | (F.col("value") == "") | F.col("value").contains('"')
        dialect = "full" if lines.filter(odd).limit(1).count() else "plain"
    text = T.StructType([T.StructField(f.name, T.StringType()) for f in schema.fields])
    if dialect == "plain":
        raw = spark.read.schema(text).csv(path, mode="FAILFAST", quote='"', escape='"')
        return _typed(raw.na.fill(""), schema)
    files = spark.read.format("binaryFile").load(path)
    large = files.filter(F.col("length") > split_bytes).select("path", "length").collect()
    small = files.filter(F.col("length") <= split_bytes).select("path", "content").mapInPandas(_whole(text.names), text)
    if not large:
        return _typed(small, schema)
    return _typed(small.unionByName(_ranges(spark, large, split_bytes).mapInPandas(_parts(text.names), text)), schema)


def _rows(where: str, content: bytes, names: list[str]) -> Iterator[pd.DataFrame]:
    rows: list[list[str]] = []
    for k, row in enumerate(parse_records(content.decode("utf-8")), 1):
        if len(row) != len(names):
            raise ValueError(f"{where}: record {k} has {len(row)} fields, the schema {len(names)}")
        rows.append(row)
        if len(rows) == 65536:
            yield pd.DataFrame(rows, columns=names)
            rows = []
    yield pd.DataFrame(rows, columns=names)


def _whole(names: list[str]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                yield from _rows(path, bytes(content), names)

    return run


def _effects(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    table = classes(",", '"', "\\")
    for batch in batches:
        found = []
        for path, begin, end in zip(batch["path"], batch["begin"], batch["end"], strict=True):
            store, at = open_store(path)
            with store.open_input_file(at) as f:
                found.append(range_effect(f, begin, end, table))
        yield batch.assign(effect=found)


def _parts(names: list[str]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = classes(",", '"', "\\")
        for batch in batches:
            for r in batch.itertuples(index=False):
                store, at = open_store(r.path)
                with store.open_input_file(at) as f:
                    for place, content in pieces(f, r.begin, r.end, r.before, r.after, table):
                        try:
                            yield from _rows(r.path, content, names)
                        except ValueError as e:
                            raise ValueError(f"{r.path}, from byte {place}: {e}") from e

    return run


def _ranges(spark: SparkSession, files: list, size: int) -> DataFrame:
    """Ranges of files with the parser's states at both ends; the driver holds one row a range."""
    cuts = [(r.path, b, min(b + size, r.length)) for r in files for b in range(0, r.length, size)]
    todo = spark.createDataFrame(cuts, "path string, begin long, end long").repartition(len(cuts))
    done = todo.mapInPandas(_effects, "path string, begin long, end long, effect array<int>")
    known, state = [], RECORD
    for r in sorted(done.collect()):
        before = RECORD if r.begin == 0 else state
        state = r.effect[before]
        known.append((r.path, r.begin, r.end, before, state))
    return spark.createDataFrame(known, "path string, begin long, end long, before int, after int").repartition(len(cuts))


def write_csv(df: DataFrame, path: str, single_file: bool = False) -> None:
    """Write CSV without a header; a field is quoted only if it holds a comma, a quote or a line break."""
    out = df.select(*[to_text(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema.fields])
    out = out.coalesce(1) if single_file else out
    out.write.mode("overwrite").csv(
        path, quote='"', escape='"', emptyValue="", nullValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False
    )
