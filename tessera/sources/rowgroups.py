"""A row-group file format as a Spark data source: plain values by column, zone maps in the footer.

A file is little-endian. Each row group: row count, one offset a column (from the group's start), then a
column each of value count and values; a string is its length and bytes. Counts, offsets and lengths have
eight bytes. The footer: metadata as a string, its size with the length before it, :data:`MAGIC`. Metadata:
schema text, offsets and row counts of the groups, and a zone map (minimum and maximum by column) a group.

A task reads whole row groups, together at most ``spark.sql.files.maxPartitionBytes`` or one group. Pushed
comparisons leave out groups that their zone maps disprove, where ``spark.sql.python.filterPushdown.enabled``
is on, as this library's sessions have it; Spark still filters the rows. A Python source
isn't told the columns of a query, so :func:`read_rowgroups` takes them, and only theirs are read. Paths
are opened through ``pyarrow.fs``; executors and driver must both reach them.

The format has no nulls: writing one raises. A file of other columns than the first, a damaged footer or
header, an int128 of over 38 digits and a date beyond 32 bits of days raise. An empty table is a file
without groups; no file at all raises. ``char`` is one byte, read and written as Latin-1.
"""

from __future__ import annotations

import datetime as dt
import struct
import uuid
from collections.abc import Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from decimal import Decimal
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition,
    LessThan, LessThanOrEqual, WriterCommitMessage,
)

from tessera.sources.schema_text import format_schema, kind_of, parse_schema
from tessera.sources.store import open_store

# The last eight bytes of a file, type numbers by place, and bytes of a value.
MAGIC = 0x434C4D4E52524734
NUMBERS = ["bool", "int16", "int32", "int64", "int128", "date", "timestamp", "char", "string"]
WIDTHS = {"bool": 1, "int16": 2, "int32": 4, "int64": 8, "int128": 16, "date": 8, "timestamp": 8, "char": 1}

#: Rows of an Arrow batch that a task hands to Spark.
BATCH_ROWS = 8192
#: Footers the driver reads at once.
THREADS = 32

EPOCH = dt.datetime(1970, 1, 1)


def _files(path: str) -> list[str]:
    """Paths of the data files, in the form the file system of ``path`` takes."""
    store, at = open_store(path)
    found = [store.get_file_info(at)]
    if found[0].type == pafs.FileType.Directory:
        found = [i for i in store.get_file_info(pafs.FileSelector(at)) if not i.base_name.startswith(("_", "."))]
    return sorted(i.path for i in found if i.type == pafs.FileType.File)


class _Cursor:
    """Reads the metadata's values one after the other."""

    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, n: int) -> bytes:
        if n < 0 or self.at + n > len(self.data):
            raise ValueError("metadata ends early")
        self.at += n
        return self.data[self.at - n : self.at]

    def i64(self) -> int:
        return int.from_bytes(self.take(8), "little", signed=True)

    def i64s(self, n: int) -> list[int]:
        return list(struct.unpack(f"<{n}q", self.take(8 * n)))

    def blob(self) -> bytes:
        return self.take(self.i64())


def _zone(entry: bytes) -> tuple | None:
    """Minimum and maximum of a column, as :func:`_key` has them; None if they say nothing."""
    cur = _Cursor(entry)
    if not cur.take(1)[0]:
        return None
    kind = NUMBERS[int.from_bytes(cur.take(2), "little")]
    if kind == "string":
        return cur.blob(), cur.blob()
    low, high = cur.take(WIDTHS[kind]), cur.take(WIDTHS[kind])
    if kind == "char":  # ordered as signed bytes, which is text order in ASCII only
        return (low, high) if low[0] < 128 and high[0] < 128 else None
    return int.from_bytes(low, "little", signed=kind != "bool"), int.from_bytes(high, "little", signed=kind != "bool")


def _key(value: Any, kind: str) -> Any:
    """A filter's value in the order of zone maps, or None where the two can't be compared."""
    if kind in ("string", "char"):
        return value.encode() if isinstance(value, str) else None
    if kind == "timestamp":
        if not isinstance(value, dt.datetime):
            return None
        value = value.astimezone(dt.timezone.utc).replace(tzinfo=None) if value.tzinfo else value
        return (value - EPOCH) // dt.timedelta(microseconds=1)
    if kind == "date":
        return (value - EPOCH.date()).days if isinstance(value, dt.date) and not isinstance(value, dt.datetime) else None
    return value if isinstance(value, (int, Decimal)) else None


@dataclass
class Group:
    """A row group: where it begins, where the next part of the file does, its rows and zone map."""

    start: int
    end: int
    rows: int
    zones: list[tuple | None]


def read_footer(path: str) -> tuple[T.StructType, list[Group]]:
    """Schema and row groups of one file."""
    store, at = open_store(path)
    with store.open_input_file(at) as f:
        size = f.size()
        if size < 24:
            raise ValueError(f"{path}: no row-group file")
        length, magic = struct.unpack("<qq", f.read_at(16, size - 16))
        if magic != MAGIC or not 8 <= length <= size - 16:
            raise ValueError(f"{path}: no row-group file")
        begin = size - 16 - length
        outer = _Cursor(f.read_at(length, begin))
    cur = _Cursor(outer.blob())
    if outer.at != length:
        raise ValueError(f"{path}: the footer's size is not its metadata's")
    schema = parse_schema(cur.blob().decode())
    n = cur.i64()
    starts, rows = cur.i64s(n), cur.i64s(n)
    zones: list[list[tuple | None]] = []
    if cur.at < len(cur.data):
        for _ in range(cur.i64()):
            one = _Cursor(cur.blob())
            zones.append([_zone(one.blob()) for _ in range(one.i64())])
    zones += [[] for _ in range(n - len(zones))]
    return schema, [Group(*g) for g in zip(starts, [*starts, begin][1:], rows, zones, strict=True)]


def _string_starts(raw: memoryview, rows: int, where: str) -> np.ndarray:
    """Where each string's length stands, and the end of the last."""
    out, at, length = [0] * (rows + 1), 0, struct.Struct("<q").unpack_from
    for i in range(rows):
        if at + 8 > len(raw) or (n := length(raw, at)[0]) < 0:
            raise ValueError(f"{where}: a string column ends early")
        at += 8 + n
        out[i + 1] = at
    if at > len(raw):
        raise ValueError(f"{where}: a string column ends early")
    return np.array(out, dtype=np.int64)


def _decode(kind: str, raw: memoryview, a: int, b: int, starts: np.ndarray | None) -> pa.Array:
    """Values ``a`` to ``b`` of a column as Arrow."""
    n = b - a
    if kind == "string":
        at = starts[a : b + 1] - starts[a]
        data, text = np.frombuffer(raw[starts[a] : starts[b]], np.uint8), np.ones(at[-1], bool)
        text[(at[:-1, None] + np.arange(8)).ravel()] = False
        ends = at - 8 * np.arange(n + 1)
        if ends[-1] >= 1 << 31:
            raise ValueError(f"{n} strings of {ends[-1]} bytes exceed an Arrow batch")
        return pa.Array.from_buffers(pa.string(), n, [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(data[text])])
    part = raw[a * WIDTHS[kind] : b * WIDTHS[kind]]
    if kind == "bool":
        return pa.array(np.frombuffer(part, np.uint8) != 0)
    if kind == "char":
        return pa.array(list(bytes(part).decode("latin-1")), pa.string())
    if kind == "date":
        days = np.frombuffer(part, "<i8")
        if (days != days.astype(np.int32)).any():
            raise ValueError("a date is beyond 32 bits of days")
        part = days.astype(np.int32)
    types = {
        "int16": pa.int16(), "int32": pa.int32(), "int64": pa.int64(), "int128": pa.decimal128(38, 0),
        "date": pa.date32(), "timestamp": pa.timestamp("us"),
    }
    out = pa.Array.from_buffers(types[kind], n, [None, pa.py_buffer(part)])
    if kind == "int128":
        out.validate(full=True)
    return out


def _encode(kind: str, x: pa.Array) -> bytes:
    """A column's values in the file's form."""
    n = len(x)
    if kind == "string":
        x = x.cast(pa.large_binary())
        ends = np.frombuffer(x.buffers()[1], np.int64)[x.offset : x.offset + n + 1]
        out, text = np.empty(ends[-1] - ends[0] + 8 * n, np.uint8), np.ones(ends[-1] - ends[0] + 8 * n, bool)
        prefix = (ends[:-1] - ends[0] + 8 * np.arange(n))[:, None] + np.arange(8)
        out[prefix], text[prefix] = np.diff(ends).astype("<i8").view(np.uint8).reshape(n, 8), False
        if ends[-1] > ends[0]:
            out[text] = np.frombuffer(x.buffers()[2], np.uint8)[ends[0] : ends[-1]]
        return out.tobytes()
    if kind == "int128":
        return x.buffers()[1][16 * x.offset : 16 * (x.offset + n)].to_pybytes()
    if kind == "char":
        out = "".join(x.to_pylist()).encode("latin-1")
        if len(out) != n or pc.any(pc.not_equal(pc.utf8_length(x), 1)).as_py():
            raise ValueError("a char value is not one character")
        return out
    if kind == "bool":
        return x.cast(pa.uint8()).to_numpy().tobytes()
    if kind == "date":
        return x.cast(pa.int32()).to_numpy().astype("<i8").tobytes()
    return (x.cast(pa.int64()) if kind == "timestamp" else x).to_numpy().tobytes()


def _zone_entry(kind: str, x: pa.Array) -> bytes:
    if kind == "char":
        x = pa.array(np.frombuffer(_encode(kind, x), np.int8))
        low, high = (struct.pack("<b", v) for v in (pc.min(x).as_py(), pc.max(x).as_py()))
    else:
        ends = pc.min_max(x.cast(pa.binary()) if kind == "string" else x)
        typed = [pa.array([ends[k].as_py()], x.type) for k in ("min", "max")]
        low, high = (_encode(kind, v) for v in typed)
    return b"\x01" + struct.pack("<h", NUMBERS.index(kind)) + low + high


def _sized(data: bytes) -> bytes:
    return struct.pack("<q", len(data)) + data


class _Sink:
    """Writes one file: groups as they come, then the footer."""

    def __init__(self, out: Any, schema: T.StructType):
        self.out, self.schema, self.kinds = out, schema, [kind_of(f) for f in schema.fields]
        self.at, self.starts, self.rows, self.zones = 0, [], [], []

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def group(self, table: pa.Table) -> None:
        n, columns = table.num_rows, []
        for f, c in zip(self.schema.fields, table.columns, strict=True):
            if c.null_count:
                raise ValueError(f"column {f.name}: the format has no nulls")
            columns.append(pa.concat_arrays(c.chunks))
        parts = [struct.pack("<q", n) + _encode(k, c) for k, c in zip(self.kinds, columns, strict=True)]
        offsets = np.cumsum([8 + 8 * len(parts), *map(len, parts)])[:-1]
        self.starts.append(self.at)
        self.rows.append(n)
        zones = b"".join(_sized(_zone_entry(k, c)) for k, c in zip(self.kinds, columns, strict=True))
        self.zones.append(struct.pack("<q", len(parts)) + zones)
        self._put(struct.pack("<q", n) + offsets.astype("<i8").tobytes())
        for p in parts:
            self._put(p)

    def finish(self) -> None:
        n = len(self.starts)
        meta = _sized(format_schema(self.schema).encode()) + struct.pack(f"<q{2 * n}q", n, *self.starts, *self.rows)
        meta = _sized(meta + struct.pack("<q", n) + b"".join(map(_sized, self.zones)))
        self._put(meta + struct.pack("<qq", len(meta), MAGIC))


@dataclass
class _Part(InputPartition):
    """Groups of one file that a task reads."""

    path: str
    groups: list[Group]


OPERATORS = {EqualTo: "eq", In: "in", LessThan: "lt", LessThanOrEqual: "le", GreaterThan: "gt", GreaterThanOrEqual: "ge"}


def _may_hold(zone: tuple, op: str, values: list) -> bool:
    """Whether a column between the zone's ends may hold a value that passes."""
    low, high = zone
    if op in ("eq", "in"):
        return any(low <= v <= high for v in values)
    v = values[0]
    return {"lt": low < v, "le": low <= v, "gt": high > v, "ge": high >= v}[op]


class _Reader(DataSourceReader):
    def __init__(self, path: str, schema: T.StructType, columns: Sequence[str], part_bytes: int):
        self.path, self.file_schema, self.columns, self.part_bytes = path, schema, list(columns), part_bytes
        self.bounds: list[tuple[int, str, list]] = []

    def _keeps(self, g: Group) -> bool:
        return all(k >= len(g.zones) or g.zones[k] is None or _may_hold(g.zones[k], op, vs) for k, op, vs in self.bounds)

    def partitions(self) -> list[_Part]:
        paths = _files(self.path)
        with ThreadPoolExecutor(THREADS) as pool:
            footers = list(pool.map(read_footer, paths))
        out: list[_Part] = []
        for path, (schema, groups) in zip(paths, footers, strict=True):
            if schema != self.file_schema:
                raise ValueError(f"{path}: other columns than the first file")
            part, size = None, 0
            for g in filter(self._keeps, groups):
                if part is None or size + g.end - g.start > self.part_bytes:
                    part, size = _Part(path, []), 0
                    out.append(part)
                part.groups.append(g)
                size += g.end - g.start
        return out or [_Part(paths[0], [])]

    def read(self, partition: _Part) -> Iterator[pa.RecordBatch]:
        names, width = self.file_schema.names, len(self.file_schema.names)
        wanted = [(names.index(c), kind_of(self.file_schema[c])) for c in self.columns]
        store, at = open_store(partition.path)
        with store.open_input_file(at) as f:
            for g in partition.groups:
                rows, *offsets = struct.unpack(f"<{width + 1}q", f.read_at(8 * (width + 1), g.start))
                if rows != g.rows or min(offsets, default=8) < 8:
                    raise ValueError(f"{partition.path}: a row group is not what the footer says")
                ends, columns = sorted([*offsets, g.end - g.start]), []
                for k, kind in wanted:
                    end = next((e for e in ends if e > offsets[k]), offsets[k])
                    raw = memoryview(f.read_at(end - offsets[k], g.start + offsets[k]))
                    where = f"{partition.path}: {names[k]}"
                    if len(raw) < 8 or struct.unpack_from("<q", raw)[0] != rows or len(raw) - 8 < rows * WIDTHS.get(kind, 8):
                        raise ValueError(f"{where}: a column is not of its row group's length")
                    columns.append((kind, raw[8:], _string_starts(raw[8:], rows, where) if kind == "string" else None))
                for a in range(0, rows, BATCH_ROWS):
                    b = min(rows, a + BATCH_ROWS)
                    yield pa.RecordBatch.from_arrays([_decode(k, raw, a, b, s) for k, raw, s in columns], names=self.columns)


class _PushReader(_Reader):
    """Spark refuses a reader with this method where its pushdown to Python sources is off."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        for f in filters:
            op = OPERATORS.get(type(f))
            if op and len(f.attribute) == 1 and f.attribute[0] in self.file_schema.names:
                k = self.file_schema.names.index(f.attribute[0])
                kind = kind_of(self.file_schema.fields[k])
                values = [_key(v, kind) for v in (f.value if op == "in" else [f.value])]
                if values and None not in values:
                    self.bounds.append((k, op, values))
            yield f


@dataclass
class _Written(WriterCommitMessage):
    name: str | None


class _Writer(DataSourceArrowWriter):
    """Each attempt of a task writes a file of its own to a hidden folder; only those of the attempts that
    Spark accepts are moved to the table, so a lost executor leaves nothing there.
    """

    def __init__(self, path: str, schema: T.StructType, overwrite: bool, rows: int, group_bytes: int):
        self.path, self.schema, self.overwrite, self.rows, self.group_bytes = path, schema, overwrite, rows, group_bytes
        self.job = f"_temporary-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        store, at = open_store(self.path)
        number = TaskContext.get().partitionId()
        first = next((b for b in iterator if b.num_rows), None)
        if first is None and number:
            return _Written(None)
        store.create_dir(f"{at}/{self.job}", recursive=True)
        name = f"part-{number:05d}-{uuid.uuid4().hex}.rg"
        with store.open_output_stream(f"{at}/{self.job}/{name}") as out:
            sink = _Sink(out, self.schema)
            held: list[pa.RecordBatch] = []
            rows = size = 0
            for batch in ([] if first is None else _chain(first, iterator)):
                while batch.num_rows:
                    part = batch.slice(0, self.rows - rows)
                    batch = batch.slice(part.num_rows)
                    held.append(part)
                    rows, size = rows + part.num_rows, size + part.nbytes
                    if rows == self.rows or size >= self.group_bytes:
                        sink.group(pa.Table.from_batches(held))
                        held, rows, size = [], 0, 0
            if held:
                sink.group(pa.Table.from_batches(held))
            sink.finish()
        return _Written(name)

    def commit(self, messages: list[_Written | None]) -> None:
        store, at = open_store(self.path)
        old = _files(self.path) if self.overwrite else []
        for m in messages:
            if m and m.name:
                store.move(f"{at}/{self.job}/{m.name}", f"{at}/{m.name}")
        for path in old:
            store.delete_file(path)
        self.abort(messages)

    def abort(self, messages: list[_Written | None]) -> None:
        store, at = open_store(self.path)
        if store.get_file_info(f"{at}/{self.job}").type == pafs.FileType.Directory:
            store.delete_dir(f"{at}/{self.job}")


def _chain(first: pa.RecordBatch, rest: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield first
    yield from rest


class RowGroups(DataSource):
    """``spark.read.format("rowgroups").option("path", p)``, and the same for ``df.write``."""

    @classmethod
    def name(cls) -> str:
        return "rowgroups"

    def _file_schema(self) -> T.StructType:
        paths = _files(self.options["path"])
        if not paths:
            raise ValueError(f"{self.options['path']}: no file")
        return read_footer(paths[0])[0]

    def _columns(self, schema: T.StructType) -> list[str]:
        names = self.options.get("columns")
        chosen = schema.names if names is None else names.split("\n")
        if missing := [c for c in chosen if c not in schema.names]:
            raise ValueError(f"no column {', '.join(missing)}")
        return chosen

    def schema(self) -> T.StructType:
        found = self._file_schema()
        return T.StructType([found[c] for c in self._columns(found)])

    def reader(self, schema: T.StructType) -> _Reader:
        found = self._file_schema()
        kind = _PushReader if self.options.get("pushdown") == "true" else _Reader
        return kind(self.options["path"], found, self._columns(found), int(self.options.get("partbytes", 128 << 20)))

    def writer(self, schema: T.StructType, overwrite: bool) -> _Writer:
        format_schema(schema)  # raises on a type without a name
        rows, size = int(self.options.get("rows", 65536)), int(self.options.get("bytes", 128 << 20))
        return _Writer(self.options["path"], schema, overwrite, rows, size)


def read_rowgroups(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    """A file or a folder of them; of ``columns`` only, if given. A missing one raises."""
    spark.dataSource.register(RowGroups)
    size = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(
        spark.conf.get("spark.sql.files.maxPartitionBytes")
    )
    reader = spark.read.format("rowgroups").option("path", path).option("partbytes", size)
    reader = reader.option("pushdown", spark.conf.get("spark.sql.python.filterPushdown.enabled"))
    return (reader if columns is None else reader.option("columns", "\n".join(columns))).load()


def write_rowgroups(df: DataFrame, path: str, rows: int = 65536, group_bytes: int = 128 << 20, mode: str = "overwrite") -> None:
    """One file a task, of groups of ``rows`` rows; a group ends sooner at ``group_bytes``.

    ``mode``: ``overwrite`` or ``append``. Old files go once the new ones are in place; a reader in between
    sees both.
    """
    df.sparkSession.dataSource.register(RowGroups)
    df.write.format("rowgroups").mode(mode).option("path", path).option("rows", rows).option("bytes", group_bytes).save()
