"""The session this library is tuned for; any Spark 4 session works."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build(app: str = "tessera", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution, UTC and Arrow batches of bounded size."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        # texts may be long: a batch between the JVM and Python holds few rows
        "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    } | conf
    return builder.config(map=settings).getOrCreate()
