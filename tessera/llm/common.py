"""What several corpus operators share: tables, shared storage, Arrow helpers."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

_own: str | None = None


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where that is unset and all runs on this machine, as in tests, a temporary folder of it serves; on a cluster,
    whose executors wouldn't see that folder, an unset one raises.
    """
    global _own
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where.rstrip("/")
    master = spark.sparkContext.master
    if not re.fullmatch(r"local(\[.*\])?", master):
        raise ValueError(f"{master}: set spark.checkpoint.dir to a folder that driver and executors share")
    if _own is None:
        _own = f"file://{tempfile.mkdtemp(prefix='tessera-')}"
    return _own


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it again.

    This cuts the lineage and outlives any executor; ``drop_kept`` frees a table that is no longer read.
    """
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._tessera_path = path
    for made in _scratch:
        made.append(out)
    return out


def drop_kept(df: DataFrame) -> None:
    path = getattr(df, "_tessera_path", None)
    if path:
        jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(conf).delete(target, True)


_scratch: list[list[DataFrame]] = []


@contextmanager
def scratch():
    """Tables that are kept inside are dropped at the end, but for those taken out of the list that is given.

    What is lazily read from them has to be kept or collected inside.
    """
    made: list[DataFrame] = []
    _scratch.append(made)
    try:
        yield made
    finally:
        _scratch[:] = [m for m in _scratch if m is not made]
        for df in made:
            drop_kept(df)


def fresh_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores in front as long as ``df`` has such a column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


MOST_ROWS = 2500


def map_texts(df: DataFrame, run, schema) -> DataFrame:
    """``df.mapInArrow`` in batches of at most ``MOST_ROWS`` rows, from here on in the session.

    Spark's default of 10,000 would hold tens of megabytes of texts several times over in every task.
    """
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(name)) <= MOST_ROWS:
        conf.set(name, str(MOST_ROWS))
    return df.mapInArrow(run, schema)


def texts(column: pa.Array | pa.ChunkedArray) -> list[str]:
    """Strings of a column; null becomes empty."""
    return [t or "" for t in column.to_pylist()]


def slices(batches: Iterator[pa.RecordBatch], column: int, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The batches in parts of about ``most`` bytes of a string column, a row at least; bounds what a task holds."""
    for batch in batches:
        size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            done = size[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(size, done + most, "right")))
            yield batch.slice(at, end - at)
            at = end


def list_array(values: pa.Array, counts: np.ndarray) -> pa.ListArray:
    """A list column from flat values and the number of values in each row."""
    offsets = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)


def replace_column(batch: pa.RecordBatch, name: str, values: pa.Array) -> pa.RecordBatch:
    """Set a column, over one of that name or at the end."""
    i = batch.schema.get_field_index(name)
    return batch.append_column(name, values) if i < 0 else batch.set_column(i, name, values)


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices ``starts[i] .. starts[i] + lengths[i] - 1`` for every i, in one flat array."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total, dtype=np.int64) + np.repeat(starts.astype(np.int64) - (ends - lengths), lengths)
