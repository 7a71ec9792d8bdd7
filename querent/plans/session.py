"""Session factory for scripts and tests; on a cluster the caller's session is used as it is."""

from __future__ import annotations

import os

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession


def local_session(cores: int = 8, shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session with adaptive execution, UTC and Arrow."""
    os.environ.setdefault("TZ", "UTC")
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("querent")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


@contextmanager
def cpu_threads(spark: SparkSession, threads: int) -> Iterator[None]:
    """Within, shuffles have as many partitions as threads are wanted; the setting before comes back."""
    if type(threads) is not int or not 1 <= threads <= 256:
        raise ValueError("threads must be from 1 to 256")
    key = "spark.sql.shuffle.partitions"
    before = spark.conf.get(key)
    spark.conf.set(key, str(threads))
    try:
        yield
    finally:
        spark.conf.set(key, before)
