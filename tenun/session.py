"""Session settings the engine relies on."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.sources.partitionColumnTypeInference.enabled": "false",
}


def get_session(app: str = "tenun", **more: str) -> SparkSession:
    """The active session, or a new one, with the engine's settings."""
    builder = SparkSession.builder.appName(app)
    for key, value in (SETTINGS | more).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def keep_batches_small(spark: SparkSession, rows: int = 1000, size: int = 16 << 20) -> None:
    """Bound what a Python worker holds at a time where texts are long, unless the session says otherwise."""
    for key, default, bound in (("maxRecordsPerBatch", "10000", rows), ("maxBytesPerBatch", None, size)):
        key = f"spark.sql.execution.arrow.{key}"
        if spark.conf.get(key, default) == default:
            spark.conf.set(key, str(bound))
