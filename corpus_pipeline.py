"""From raw documents to packed token sequences: quality, near-duplicates, benchmark leaks, secrets, packing.

Every stage takes all documents that the one before kept, as a table read back from shared storage, and all but the last
return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import leaks, packing, quality, secrets, simhash
from tessera.llm.common import drop_kept, keep, scratch, table
from tessera.llm.tokens import tokenizer_path


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier scores 0.3 or more."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that of the smallest id."""
    return simhash.near_dedup(docs)


def untainted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of any benchmark item."""
    return leaks.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def redacted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets masked in ``text`` and ``n_chars`` to match."""
    return secrets.redact(docs, secrets.train(docs), length="n_chars" if "n_chars" in docs.columns else None)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 2048 tokens."""
    return packing.pack(docs, path=tokenizer_path("word_bpe_49k.json"))


STAGES = [
    ("quality classifier", good),
    ("SimHash near-dedup", distinct),
    ("benchmark decontamination", untainted),
    ("secret scans", redacted),
    ("best-fit packing", packed),
]

#: The stages are trained models and a packing order, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in a row; a stage's tables are freed when the next one's documents are written."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        with scratch() as made:
            after = keep(stage(spark, docs, sf_dir), f"stage{k}")
            made.remove(after)
        drop_kept(docs)
        docs = after
    with scratch() as made:
        out = STAGES[-1][1](spark, docs, sf_dir)
        made.clear()  # the result reads its tables later, and holds all that is left of the documents
    drop_kept(docs)
    return out
