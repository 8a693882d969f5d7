"""A session with the settings that the operators are tuned for."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def session(master: str | None = None, settings: dict[str, str] | None = None) -> SparkSession:
    """ANSI mode stays on, as Spark sets it; ``settings`` go over the defaults above."""
    builder = SparkSession.builder.appName("downfield").config(map=SETTINGS | (settings or {}))
    return (builder.master(master) if master else builder).getOrCreate()
