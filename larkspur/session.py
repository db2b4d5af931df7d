"""Sessions with the settings that the engine expects."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.timeType.enabled": "true",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(master: str | None = None, **settings: str) -> SparkSession:
    """The active session, or a new one; ``settings`` use __ for dots."""
    builder = SparkSession.builder
    if master:
        builder = builder.master(master).config("spark.sql.shuffle.partitions", os.environ.get("LARKSPUR_PARTITIONS", "8"))
    for name, value in {**SETTINGS, **{k.replace("__", "."): v for k, v in settings.items()}}.items():
        builder = builder.config(name, value)
    return builder.getOrCreate()


def active() -> SparkSession:
    return SparkSession.getActiveSession() or session()


def ensure(spark: SparkSession, *names: str) -> None:
    """Switch on settings that an expression needs, for the rest of the session; a plan that has it needs them whenever it runs."""
    for name in names or ("spark.sql.timeType.enabled",):
        if spark.conf.get(name, None) != SETTINGS[name]:
            spark.conf.set(name, SETTINGS[name])
