"""Session settings the engine is tuned for."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build_session(app: str = "storyloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution and skew handling on.

    On a cluster the master, memory and ``spark.checkpoint.dir`` come from spark-submit; tests and the
    bench pass a local master.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()
