"""Joins and ranks that hold when one key has a third of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from querent.plans.staging import Stage


def join_on_hot_key(rows: DataFrame, stats: DataFrame, key: str, hot_at: int, count_col: str) -> DataFrame:
    """Joins rows with per-key statistics whose ``count_col`` says how many rows have the key.

    Keys with at least ``hot_at`` rows are at most (rows / hot_at), so they are broadcast and their rows
    stay where they are; the rows of all other keys are shuffled, of which no key has many.
    """
    hot = F.broadcast(stats.filter(F.col(count_col) >= hot_at))
    cold = stats.filter(F.col(count_col) < hot_at)
    names = hot.select(F.col(key), F.lit(True).alias("_hot"), *[F.col(c).alias(f"_{c}") for c in stats.columns if c != key])
    marked = rows.join(F.broadcast(names), key, "left")
    others = [c for c in stats.columns if c != key]
    direct = marked.filter("_hot").select(*rows.columns, *[F.col(f"_{c}").alias(c) for c in others])
    moved = marked.filter("_hot is null").select(*rows.columns).join(cold, key)
    return direct.unionByName(moved.select(*rows.columns, *others))


def global_rank(stage: Stage, df: DataFrame, within: list[str], order: list[str], name: str = "rank", partitions: int | None = None) -> DataFrame:
    """Adds the 0-based rank of each row among the rows with the same ``within``, in order of ``order``.

    A window would put each group into one task. Here the rows are range-partitioned by group and
    order, numbered within each partition, and shifted by what the partitions before hold of the
    group; only counts a partition and group pass a window.
    """
    keys = [*within, *order]
    parted = df.repartitionByRange(partitions, *keys) if partitions else df.repartitionByRange(*keys)
    rows = stage.write(parted.sortWithinPartitions(*keys).withColumn("_p", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id()), "ranked")
    counts = rows.groupBy(*within, "_p").agg(F.count(F.lit(1)).alias("_n"), F.min("_i").alias("_first"))
    before = Window.partitionBy(*within).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    shifts = counts.withColumn("_shift", F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first"))
    on = F.lit(True)
    right = shifts.select(*[F.col(c).alias(f"_r_{c}") for c in within], F.col("_p").alias("_r_p"), "_shift")
    for c in within:
        on = on & F.col(c).eqNullSafe(F.col(f"_r_{c}"))
    joined = rows.join(right, on & (F.col("_p") == F.col("_r_p")))
    return joined.select(*df.columns, (F.col("_i") + F.col("_shift")).alias(name))
