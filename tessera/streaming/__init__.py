"""The relational operators are pure plan builders, so filters, projections and
grouped aggregates also accept a streaming DataFrame. This helper drains one
bounded stream; the engine has no streaming operators of its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame


def drain(stream: DataFrame, table: str, mode: str = "append", checkpoint: str | None = None) -> DataFrame:
    """Process all that is available now into the in-memory table ``table`` and return it."""
    writer = stream.writeStream.format("memory").queryName(table).outputMode(mode).trigger(availableNow=True)
    if checkpoint:
        writer = writer.option("checkpointLocation", checkpoint)
    query = writer.start()
    query.awaitTermination()
    return stream.sparkSession.table(table)
