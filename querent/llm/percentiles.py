"""Percentiles of very large numeric columns: mergeable relative-rank sketches.

A sketch is a tower of compactors. Each keeps a sorted buffer; when it is full, the small end of it is
thinned (every other value moves one level up with twice the weight) while the large end stays as it
is, so that the error of a rank is proportional to the number of values above it: percentiles near the
top, and the maximum, are almost exact. Sketches are built map-side in each partition, one a group,
and merged in two steps, so that a group with a third of all rows costs its share of each partition
and then a few kilobytes a partition.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Values of a section of a compactor: the larger, the smaller the error.
SECTION = 64
#: Merging first joins the sketches of this many partitions.
FAN = 32


def rank_error(section: int = SECTION) -> float:
    """Bound on |estimated rank - rank| / (values at or above it + 1), with about 99 % confidence.

    From the analysis of relative compactors: the error of one compaction is a fair coin on at most
    one item of its weight, and each level compacts its small end only.
    """
    return 4.0 / section


class RankSketch:
    """A relative-rank sketch that protects the large end; ``levels[i]`` holds sorted values of weight 2**i."""

    __slots__ = ("section", "levels", "states", "count", "low", "high")

    def __init__(self, section: int = SECTION) -> None:
        self.section, self.levels, self.states = section, [np.zeros(0)], [0]
        self.count, self.low, self.high = 0, np.inf, -np.inf

    def capacity(self, level: int) -> int:
        """Twice the sections that the number of compactions so far calls for."""
        sections = 3
        while self.states[level] >= 1 << (sections - 1):
            sections += 1
        return 2 * self.section * sections

    def add(self, values: np.ndarray) -> None:
        """Adds values in any order."""
        if len(values):
            self.count += len(values)
            self.low, self.high = min(self.low, float(values.min())), max(self.high, float(values.max()))
            self.levels[0] = np.sort(np.concatenate([self.levels[0], values]))
            self._compact()

    def merge(self, other: RankSketch) -> None:
        """Takes in another sketch; the result has the error bound of one sketch of all values."""
        self.count += other.count
        self.low, self.high = min(self.low, other.low), max(self.high, other.high)
        while len(self.levels) < len(other.levels):
            self.levels.append(np.zeros(0))
            self.states.append(0)
        for i, values in enumerate(other.levels):
            self.levels[i] = np.sort(np.concatenate([self.levels[i], values]))
            self.states[i] |= other.states[i]
        self._compact()

    def _compact(self) -> None:
        level = 0
        while level < len(self.levels):
            values, cap = self.levels[level], self.capacity(level)
            if len(values) >= cap:
                # the sections that take part follow the trailing ones of the state, as in a binary counter
                ones = (~self.states[level] & (self.states[level] + 1)).bit_length()
                keep = min(len(values), max(cap // 2, cap - ones * self.section))
                thin = (len(values) - keep) // 2 * 2
                if thin:
                    if level + 1 == len(self.levels):
                        self.levels.append(np.zeros(0))
                        self.states.append(0)
                    # a coin that depends on the data seen so far, so that a lost task gives the same again
                    coin = (self.count * 0x9E3779B97F4A7C15 + self.states[level] * 0xC2B2AE3D27D4EB4F >> 31) & 1
                    self.levels[level + 1] = np.sort(np.concatenate([self.levels[level + 1], values[coin:thin:2]]))
                    self.levels[level] = values[thin:]
                    self.states[level] += 1
                if len(self.levels[level]) >= cap:
                    continue
            level += 1

    def quantiles(self, shares: list[float]) -> list[float | None]:
        """Linear interpolation between the values at the ranks around share * (count - 1)."""
        if not self.count:
            return [None] * len(shares)
        values = np.concatenate(self.levels)
        weights = np.concatenate([np.full(len(v), 1 << i, np.int64) for i, v in enumerate(self.levels)])
        order = np.argsort(values, kind="stable")
        values, upto = values[order], np.cumsum(weights[order])
        out = []
        for share in shares:
            at = share * (self.count - 1)
            below = int(np.floor(at))
            v = values[np.minimum(np.searchsorted(upto, [below, below + 1], side="right"), len(values) - 1)]
            v = [self.low if below == 0 else v[0], self.high if below + 1 >= self.count - 1 else v[1]]
            out.append(float(v[0] + (at - below) * (v[1] - v[0])) if at > below else float(self.high if below == self.count - 1 else v[0]))
        return out

    def to_bytes(self) -> bytes:
        head = struct.pack("<iqddi", self.section, self.count, self.low, self.high, len(self.levels))
        return head + b"".join(struct.pack("<iq", len(v), s) + v.astype("<f8").tobytes() for v, s in zip(self.levels, self.states))

    @classmethod
    def from_bytes(cls, data: bytes) -> RankSketch:
        out = cls()
        out.section, out.count, out.low, out.high, n = struct.unpack_from("<iqddi", data)
        out.levels, out.states, at = [], [], struct.calcsize("<iqddi")
        for _ in range(n):
            size, state = struct.unpack_from("<iq", data, at)
            at += 12
            out.levels.append(np.frombuffer(data, "<f8", size, at).copy())
            out.states.append(state)
            at += 8 * size
        return out


def usable(value: Column, ceiling: float | None) -> Column:
    """Finite, not negative, and below the ceiling if there is one."""
    ok = value.isNotNull() & ~F.isnan(value) & (value >= 0) & (value < float("inf"))
    return ok if ceiling is None else ok & (value < ceiling)


def build_sketches(df: DataFrame, by: list[str], fields: list[str], ceiling: float | None = None, section: int = SECTION) -> DataFrame:
    """(by..., field, n, sketch): one sketch a group and field, over the usable values.

    Null keys are a group of their own; groups without usable values give no row; an empty table gives
    none. Columns of the input other than ``by`` and ``fields`` are not read.
    """
    codes = [f"k{i}" for i in range(len(by))]
    src = df.select(*[F.col(c).cast("string").alias(k) for c, k in zip(by, codes)], *[F.when(usable(F.col(c).cast("double"), ceiling), F.col(c).cast("double")).alias(f"v{i}") for i, c in enumerate(fields)])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, RankSketch] = {}
        salt = TaskContext.get().partitionId() // FAN
        for b in batches:
            if not b.num_rows:
                continue
            keys = [b.column(i).dictionary_encode() for i in range(len(by))]
            code = np.zeros(b.num_rows, np.int64)
            for k in keys:
                code = code * (len(k.dictionary) + 1) + np.asarray(k.indices.fill_null(len(k.dictionary)))
            order = np.argsort(code, kind="stable")
            starts = np.flatnonzero(np.r_[True, np.diff(code[order]) != 0])
            names = list(zip(*(k.take(pa.array(order[starts])).to_pylist() for k in keys))) if by else [()] * len(starts)
            for i, field in enumerate(fields):
                values = np.asarray(b.column(len(by) + i).fill_null(np.nan))[order]
                for name, part in zip(names, np.split(values, starts[1:])):
                    part = part[~np.isnan(part)]
                    if len(part):
                        if (name, field) not in held:
                            held[name, field] = RankSketch(section)
                        held[name, field].add(part)
        rows = [(*name, field, salt, s.to_bytes()) for (name, field), s in held.items()]
        cols = list(zip(*rows)) if rows else [[]] * (len(by) + 3)
        kinds = [pa.string()] * len(by) + [pa.string(), pa.int32(), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds)], [*codes, "field", "salt", "sketch"])

    keyed = ", ".join(f"{k} string" for k in codes) + (", " if by else "")
    made = src.mapInArrow(build, f"{keyed}field string, salt int, sketch binary")
    merged = merge_sketches(made, [*codes, "field", "salt"]).drop("n")
    merged = merge_sketches(merged, [*codes, "field"])
    back = [F.col(k).cast(df.schema[c].dataType).alias(c) for c, k in zip(by, codes)]
    return merged.select(*back, "field", "n", "sketch")


def _merged(width: int):
    """Merges the sketches of consecutive rows with the same first ``width`` columns; the last column is the sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, whole, head, schema = None, None, None, None

        def done() -> pa.RecordBatch:
            names = [*schema.names[:width], "n", "sketch"]
            return pa.RecordBatch.from_arrays([*head, pa.array([whole.count], pa.int64()), pa.array([whole.to_bytes()], pa.binary())], names)

        ready: list[pa.RecordBatch] = []
        for b in batches:
            schema = b.schema
            keys = list(zip(*(c.to_pylist() for c in b.columns[:width]))) if width else [()] * b.num_rows
            for i, (key, data) in enumerate(zip(keys, b.column(width).to_pylist())):
                part = RankSketch.from_bytes(data)
                if key == now and whole is not None:
                    whole.merge(part)
                    continue
                if whole is not None:
                    ready.append(done())
                now, whole, head = key, part, [c.slice(i, 1) for c in b.columns[:width]]
                if len(ready) >= 256:
                    yield from pa.Table.from_batches(ready).combine_chunks().to_batches()
                    ready = []
        if whole is not None:
            ready.append(done())
        if ready:
            yield from pa.Table.from_batches(ready).combine_chunks().to_batches()

    return run


def merge_sketches(df: DataFrame, by: list[str], sketch: str = "sketch") -> DataFrame:
    """(by..., n, sketch): merges the sketches of each group, such as those of several days or runs.

    Each group's sketches are merged one after the other, in the order of their bytes, so that a task
    holds one of them. Null sketches take no part; null keys are a group of their own; an empty table
    gives no rows.
    """
    fields = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    given = df.select(*by, F.col(sketch).alias("_sketch")).filter(F.col("_sketch").isNotNull())
    laid = (given.repartition(*by) if by else given.repartition(1)).sortWithinPartitions(*by, "_sketch")
    schema = ", ".join(f"`{c}` {fields[c]}" for c in by) + (", " if by else "") + "n bigint, sketch binary"
    return laid.mapInArrow(_merged(len(by)), schema)


def sketch_quantiles(df: DataFrame, shares: list[float], sketch: str = "sketch") -> DataFrame:
    """Adds ``quantiles``: an array of the percentiles of each row's sketch."""

    @F.pandas_udf("array<double>")
    def read(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else RankSketch.from_bytes(bytes(x)).quantiles(shares))

    return df.withColumn("quantiles", read(F.col(sketch)))


def distinct_attempts(runner: DataFrame, columns: list[str]) -> DataFrame:
    """One row an attempt_id (its repeats differ only in when they were logged); rows without id are attempts of their own."""
    known = runner.filter("attempt_id is not null").select("attempt_id", *columns).groupBy("attempt_id").agg(F.min(F.struct(*columns)).alias("x"))
    return known.select("x.*").unionByName(runner.filter("attempt_id is null").select(*columns))
