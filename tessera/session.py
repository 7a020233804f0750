"""Session factory with the settings the engine's semantics rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Semantics, not tuning: UTC wall clocks, loud overflow, timestamps without zone.
SEMANTICS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.timestampType": "TIMESTAMP_NTZ",
}

#: Runtime re-planning: coalesces small shuffle partitions, splits skewed ones.
TUNING = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.python.filterPushdown.enabled": "true",  # zone maps of the row-group source
}


def get_session(app: str = "tessera", master: str | None = None, **conf: str) -> SparkSession:
    """A session with :data:`SEMANTICS` and :data:`TUNING`; ``conf`` overrides both.

    ``master`` stays unset by default, so ``spark-submit`` decides it.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SEMANTICS, **TUNING, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
