"""Which session to use: the one of the DataFrame at hand, one that was registered, or the active one."""

from __future__ import annotations

from pyspark.sql import SparkSession

_registered: SparkSession | None = None


def set_spark(spark: SparkSession | None) -> None:
    """Registers a session for calls that name none; None takes it back."""
    global _registered
    _registered = spark


def get_spark(spark: SparkSession | None = None) -> SparkSession:
    """``spark``, else the registered session, else the active one. None is ever created."""
    found = spark or _registered or SparkSession.getActiveSession()
    if found is None:
        raise RuntimeError("no Spark session: create one, or register one with set_spark()")
    return found
