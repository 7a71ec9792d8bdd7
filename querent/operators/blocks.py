"""Searches in blocks: a set of queries against all rows, as products of blocks of both.

Rows are packed where they lie into blocks of bounded size. Every block of queries visits every block
of the index; a pair of blocks is one product in NumPy, of which each query keeps its k best, so that
what is shuffled besides the blocks are k rows for each query and block of the index.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from querent.plans.staging import shuffle_partitions


def packed(rows: DataFrame, size: int) -> DataFrame:
    """One row for at most ``size`` rows: each column as an array."""

    def one(t: pa.Table) -> pa.RecordBatch:
        t = t.combine_chunks()
        lists = [pa.ListArray.from_arrays(pa.array([0, t.num_rows], pa.int32()), pa.concat_arrays(c.chunks)) for c in t.columns]
        return pa.RecordBatch.from_arrays(lists, t.column_names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            if b.num_rows:
                held.append(b)
            while sum(x.num_rows for x in held) >= size:
                t = pa.Table.from_batches(held)
                yield one(t.slice(0, size))
                held = [x for x in t.slice(size).to_batches() if x.num_rows]
        if held:
            yield one(pa.Table.from_batches(held))

    return rows.mapInArrow(run, T.StructType([T.StructField(f.name, T.ArrayType(f.dataType)) for f in rows.schema.fields]))


def unpacked(column: pa.ChunkedArray, row: int = 0) -> pa.Array:
    """The elements of one packed value."""
    return column.combine_chunks()[row].values if not isinstance(column, pa.ChunkedArray) else column[row].values


def best_in_rows(scores: np.ndarray, ids: np.ndarray, k: int, above: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the k largest scores of each row that are over ``above``, equal ones by id."""
    line = np.full(len(scores), -np.inf)
    if scores.shape[1] > k:
        line = np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k]
    row, col = np.nonzero((scores >= line[:, None]) & (scores > above))
    place = np.empty(len(ids), np.int64)
    place[np.argsort(ids, kind="stable")] = np.arange(len(ids))
    order = np.lexsort((place[col], -scores[row, col], row))
    row, col = row[order], col[order]
    begin = np.flatnonzero(np.r_[True, row[1:] != row[:-1]]) if len(row) else np.zeros(0, int)
    rank = np.arange(len(row)) - np.repeat(begin, np.diff(np.r_[begin, len(row)]))
    return row[rank < k], col[rank < k]


def visit_blocks(index: DataFrame, queries: DataFrame, name: Column, visit: Callable[[pa.Table, pa.Table], pa.Table], shape: str, most: int | None = None) -> DataFrame:
    """The rows of ``visit(index row, query rows)``; every block of the queries meets every block of the index once.

    Both are staged tables with a block a row; ``name`` tells the blocks of the queries apart. While there
    are few blocks of the index, each is copied so that all partitions have work; also so that a copy meets
    ``most`` blocks of the queries, as far as hashing deals them evenly.
    """
    spark = index.sparkSession
    count, asked = index.count(), queries.count()
    copies = max(1, min(asked, max(-(-2 * shuffle_partitions(spark) // max(1, count)), -(-asked // most) if most else 1)))
    left = index.withColumn("_block", F.monotonically_increasing_id())
    blocks = [r["_block"] for r in left.select("_block").collect()]
    left = left.withColumn("_copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
    visited = F.array(*[F.lit(b) for b in blocks]) if blocks else F.array().cast("array<bigint>")
    right = queries.withColumn("_copy", F.pmod(F.xxhash64(name), F.lit(copies)).cast("int")).withColumn("_block", F.explode(visited))
    keys = ["_block", "_copy"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(visit, shape)


def search_blocks(index: DataFrame, queries: DataFrame, score: Callable[[pa.Table, pa.Table, int], np.ndarray], k: int, kinds: tuple[str, str], above: float = -np.inf) -> DataFrame:
    """(query_id, doc_id, score): the k best of each block of the index for each query.

    ``index`` has doc_id (array) and ``queries`` query_id (array), a block a row; both are staged
    tables. ``score(index row, query rows, i)`` gives the scores of the i-th query block.
    """

    def visit(own: pa.Table, asking: pa.Table) -> pa.Table:
        out = []
        if own.num_rows:
            ids = unpacked(own["doc_id"])
            names = ids.to_numpy(zero_copy_only=False)
            for i in range(asking.num_rows):
                scores = np.round(score(own, asking, i), 12)
                row, col = best_in_rows(scores, names, k, above)
                out.append(pa.table([unpacked(asking["query_id"], i).take(pa.array(row)), ids.take(pa.array(col)), pa.array(scores[row, col])], ["query_id", "doc_id", "score"]))
        return pa.concat_tables(out) if out else pa.table({"query_id": pa.array([], asking.schema.field("query_id").type.value_type), "doc_id": pa.array([], own.schema.field("doc_id").type.value_type), "score": pa.array([], pa.float64())})

    return visit_blocks(index, queries, F.get("query_id", F.lit(0)).cast("string"), visit, f"query_id {kinds[0]}, doc_id {kinds[1]}, score double")
