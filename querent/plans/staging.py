"""Written tables that cut lineage.

Iterative operators write each round to Parquet in the shared folder that the cluster names in
``spark.checkpoint.dir`` and read it back: a lost executor then costs a task, not the whole history,
and the files are columnar and compressed. Only a session of this one machine (tests, notebooks) may
leave that setting out; it gets a temporary folder.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager, suppress

from pyspark.sql import DataFrame, SparkSession

_LOCAL_DIRS: dict[str, str] = {}
_STAGES: list[Stage] = []
#: Shuffle files of a finished write are of no more use: its rows are read from the written table.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The session's shared folder; a temporary one only where all tasks run in this process."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise RuntimeError(f"spark.checkpoint.dir isn't set; on {master} staged tables need a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_DIRS:
        _LOCAL_DIRS[app] = tempfile.mkdtemp(prefix="querent-")
        atexit.register(shutil.rmtree, _LOCAL_DIRS[app], ignore_errors=True)
    return _LOCAL_DIRS[app]


@contextmanager
def _without_leftovers(spark: SparkSession) -> Iterator[None]:
    """Within, the shuffle files of each execution go when it ends; where Spark has no such setting they wait for its cleaner."""
    before = spark.conf.get(_CLEANUP, None)
    if before is None:
        yield
        return
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


class Stage:
    """The staged tables of one operator call.

    ``drop`` removes those no longer needed. Those that the result still reads stay until ``close``,
    or ``close_all``, which also runs when the program ends.
    """

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark, self.root = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self._n = 0
        _STAGES.append(self)

    def write(self, df: DataFrame, label: str) -> DataFrame:
        """Writes ``df`` and returns it as read from the files."""
        self._n += 1
        path = f"{self.root}/{self._n:03d}-{label}"
        with _without_leftovers(self.spark):
            df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._staged_path = path
        return out

    def drop(self, *dfs: DataFrame | None) -> None:
        """Removes staged tables that nothing reads any more."""
        for df in dfs:
            if path := getattr(df, "_staged_path", None):
                self._delete(path)

    def close(self) -> None:
        """Removes all tables of the call; frames that read them can't be used any more."""
        self._delete(self.root)

    def _delete(self, path: str) -> None:
        context = self.spark.sparkContext
        where = context._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(context._jsc.hadoopConfiguration()).delete(where, True)


def close_all() -> None:
    """Removes the staged tables of all calls; frames that read them can't be used any more."""
    while _STAGES:
        _STAGES.pop().close()


def _at_exit() -> None:
    with suppress(Exception):  # the session may have ended before the program
        close_all()


atexit.register(_at_exit)


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
