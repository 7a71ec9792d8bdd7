"""What Python workers keep between tasks, and files that travel to them."""

from __future__ import annotations

import os
import sys
from collections.abc import Callable
from typing import Any

from pyspark import SparkFiles
from pyspark.sql import SparkSession


def once(key: tuple, make: Callable[[], Any]) -> Any:
    """A value that is made once in each Python process.

    Functions travel to the workers with their code, so their module's variables are new in each task;
    what a process keeps lies in ``sys``, which every task of it shares.
    """
    kept = sys.__dict__.setdefault("_querent_kept", {})
    if key not in kept:
        kept[key] = make()
    return kept[key]


def ship(spark: SparkSession, path: str) -> str:
    """Sends a file of the driver to all workers; ``shipped`` finds it there."""
    spark.sparkContext.addFile(path)
    return path


def shipped(path: str) -> str:
    """Where a shipped file lies in this process; the path itself if it wasn't shipped."""
    try:
        here = SparkFiles.get(os.path.basename(path))
    except Exception:  # noqa: BLE001 - no session and no worker
        return path
    return here if os.path.exists(here) else path
