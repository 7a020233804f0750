"""Schema text: one ``name,type`` line per column; anything after a second comma is ignored."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import types as T

# The type names of the schema text format.
TYPES: dict[str, T.DataType] = {
    "bool": T.BooleanType(),
    "int16": T.ShortType(),
    "int32": T.IntegerType(),
    "int64": T.LongType(),
    "int128": T.DecimalType(38, 0),
    "date": T.DateType(),
    "timestamp": T.TimestampNTZType(),
    "char": T.StringType(),
    "string": T.StringType(),
}


def parse_schema(text: str) -> T.StructType:
    """Parse schema text. A ``char`` column carries ``{"char": True}`` in its metadata."""
    fields = []
    for number, line in enumerate(text.splitlines(), 1):
        if not line.strip():
            continue
        name, kind, *_ = [*line.split(","), ""]
        kind = kind.strip()
        if kind not in TYPES:
            raise ValueError(f"line {number}: unknown type {kind!r} of column {name!r}")
        fields.append(T.StructField(name, TYPES[kind], False, {"char": True} if kind == "char" else None))
    return T.StructType(fields)


def kind_of(f: T.StructField) -> str:
    """The type name of a column; a type without one raises."""
    kind = "char" if f.metadata.get("char") else next((k for k, t in TYPES.items() if t == f.dataType and k != "char"), None)
    if kind is None:
        raise ValueError(f"column {f.name}: {f.dataType.simpleString()} has no name in schema text")
    return kind


def format_schema(schema: T.StructType) -> str:
    """Inverse of :func:`parse_schema`."""
    return "".join(f"{f.name},{kind_of(f)}\n" for f in schema.fields)


def read_schema(spark: SparkSession, path: str) -> T.StructType:
    """Read a schema file from any store Spark reaches."""
    return parse_schema(spark.read.text(path, wholetext=True).first()[0])


def write_schema(spark: SparkSession, schema: T.StructType, path: str) -> None:
    """Write schema text as a one-file text folder."""
    rows = [(x,) for x in format_schema(schema).splitlines()]
    spark.createDataFrame(rows, "value string").coalesce(1).write.mode("overwrite").text(path)
