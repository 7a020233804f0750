"""Bounded samples of labelled documents, and the folds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(doc: str = "doc_id") -> Column:
    """CRC-32 of the id as text, modulo 5; rows of fold 0 are held out. A null id is in fold 0."""
    return F.coalesce(F.pmod(F.crc32(F.encode(F.col(doc).cast("string"), "utf-8")), F.lit(5)), F.lit(0))


def labelled(docs: DataFrame, labels: DataFrame, label: str, bound: int) -> DataFrame:
    """``doc_id``, ``text`` and ``label`` of at most ``bound`` labels outside fold 0, chosen by hash of the id.

    The chosen labels are the ones broadcast, so their size is bounded by ``bound``. A label has one row: of several
    texts with its id the one of the smallest hash.
    """
    usable = labels.filter(F.col(label).isin(0, 1) & (fold() != 0)).select("doc_id", F.col(label).cast("int").alias("label"))
    chosen = usable.distinct().orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(bound)
    found = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    return found.groupBy("doc_id", "label").agg(F.min_by("text", F.xxhash64("text")).alias("text")).select("doc_id", "text", "label")
