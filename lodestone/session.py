"""The Spark session this library runs best in."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Static planning by size and statistics, adaptive planning at run time.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.cbo.enabled": "true",
    "spark.sql.cbo.joinReorder.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def create_session(master: str | None = None, conf: dict[str, str] | None = None) -> SparkSession:
    """A session with DEFAULTS and conf on top; master is left to the environment unless given."""
    builder = SparkSession.builder.appName("lodestone")
    if master:
        builder = builder.master(master)
    return builder.config(map=DEFAULTS | (conf or {})).getOrCreate()
