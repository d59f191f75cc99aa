"""Session settings that the operators rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def build_session(master: str | None = None, app: str = "netquarry", **more: str) -> SparkSession:
    """A session with UTC time, adaptive execution and Arrow transfer on."""
    b = SparkSession.builder.appName(app).config(map=SETTINGS | more)
    return (b.master(master) if master else b).getOrCreate()
