"""Files opened by byte range, on the driver and in tasks alike, and the folder that both share."""

from __future__ import annotations

import os
import re
import tempfile
from functools import cache

from pyarrow import fs
from pyspark.sql import SparkSession


def open_store(path: str) -> tuple[fs.FileSystem, str]:
    """File system and path in it, of a local path or a URI that ``pyarrow.fs`` knows."""
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    if ":/" in path:
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), os.path.abspath(path)


@cache
def _own_folder() -> str:
    return f"file://{tempfile.mkdtemp(prefix='tessera-')}"


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; with a local master a temporary folder where that is unset, else an error."""
    if where := spark.conf.get("spark.checkpoint.dir", None):
        return where.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return _own_folder()
