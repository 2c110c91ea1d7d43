"""Session settings the engine expects."""

from __future__ import annotations

from pyspark.sql import SparkSession

# UTC makes timestamps comparable across engines; adaptive execution sizes shuffles at run time.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def session(app: str = "lodestone", master: str | None = None, **more: str) -> SparkSession:
    """A session with the engine's settings; `more` are further ones, `_` for `.`."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in (SETTINGS | {k.replace("_", "."): v for k, v in more.items()}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
