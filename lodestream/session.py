"""Session settings the engine is written for."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def get_session(app: str = "lodestream", master: str | None = None, **conf: str) -> SparkSession:
    """A session with SETTINGS; size spark.sql.shuffle.partitions to the data (about 100 MB a partition)."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for k, v in {**SETTINGS, **{k.replace("__", "."): v for k, v in conf.items()}}.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


@contextmanager
def connected(app: str = "lodestream", master: str | None = None, **conf: str) -> Iterator[SparkSession]:
    """get_session for the length of a with statement. A session that was there before stays; one of our own is stopped."""
    mine = SparkSession.getActiveSession() is None
    spark = get_session(app, master, **conf)
    try:
        yield spark
    finally:
        if mine:
            spark.stop()
