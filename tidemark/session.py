"""Session helper. Library code never builds a session; applications and tests do."""

from __future__ import annotations

from pyspark.sql import SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def builder(app_name: str = "tidemark", **conf: str) -> SparkSession.Builder:
    """A builder with the settings the operators assume; `conf` overrides them."""
    b = SparkSession.builder.appName(app_name)
    for name, value in {**DEFAULTS, **conf}.items():
        b = b.config(name, value)
    return b
