"""Session helper with the settings the engine expects."""

from __future__ import annotations

from pyspark.sql import SparkSession


def get_session(master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution, skew handling and Arrow batches sized for text."""
    b = SparkSession.builder.appName("placewright")
    if master:
        b = b.master(master)
    defaults = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.maxRecordsPerBatch": "4096",
        "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
    }
    for k, v in (defaults | conf).items():
        b = b.config(k, v)
    return b.getOrCreate()
