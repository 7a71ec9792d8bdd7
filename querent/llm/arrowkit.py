"""Small helpers for operators that work on Arrow batches with NumPy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def matrix(column: pa.Array | pa.ChunkedArray, width: int, dtype: str) -> np.ndarray:
    """A binary column whose values all hold ``width`` numbers, as a matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.binary())
    if len(column) == 0:
        return np.zeros((0, width), dtype)
    wide = pa.types.is_large_binary(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    return data.view(dtype).reshape(len(column), width) if data.ctypes.data % np.dtype(dtype).itemsize == 0 else np.frombuffer(data.tobytes(), dtype).reshape(len(column), width)


def flat(column: pa.ChunkedArray | pa.Array, dtype: str) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of a binary column, and how many each value holds."""
    chunks = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    size, data, counts = np.dtype(dtype).itemsize, [], []
    for c in chunks:
        wide = pa.types.is_large_binary(c.type)
        offsets = np.frombuffer(c.buffers()[1], np.int64 if wide else np.int32)[c.offset : c.offset + len(c) + 1]
        data.append(np.frombuffer(c.buffers()[2], np.uint8)[offsets[0] : offsets[-1]])
        counts.append(np.diff(offsets) // size)
    joined = np.concatenate(data) if data else np.zeros(0, np.uint8)
    return np.frombuffer(joined.tobytes(), dtype), np.concatenate(counts) if counts else np.zeros(0, int)


def binary(rows: np.ndarray) -> pa.Array:
    """A matrix as a binary column, one value a row."""
    rows = np.ascontiguousarray(rows)
    n, size = len(rows), rows.dtype.itemsize * rows.shape[1]
    offsets = (np.arange(n + 1, dtype=np.int64) * size).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(rows.tobytes())])


def sliced(table: pa.Table, rows: int) -> Iterator[pa.RecordBatch]:
    """A table as batches small enough for 32-bit offsets."""
    yield from table.combine_chunks().to_batches(max_chunksize=rows)


def gathered(batches: Iterator[pa.RecordBatch]) -> pa.Table | None:
    """All batches of one partition, whose size the caller bounds by the number of partitions."""
    got = [b for b in batches if b.num_rows]
    return pa.Table.from_batches(got).combine_chunks() if got else None


def whole_groups(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.Table]:
    """Rows that are sorted by an integer column, in tables that split no group; only the last group of a batch is held back."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        keys = np.asarray(b.column(b.schema.get_field_index(column)))
        cut = int(np.searchsorted(keys, keys[-1]))
        if cut or (held and held[-1].column(column)[0].as_py() != keys[-1]):
            yield pa.Table.from_batches([*held, b.slice(0, cut)]).combine_chunks()
            held = []
        held.append(b.slice(cut))
    if held:
        yield pa.Table.from_batches(held).combine_chunks()
