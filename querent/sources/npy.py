"""Embeddings in NumPy's file format: facts from the header alone, and rows of a table."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_DIMENSION, MAX_BYTES = 8192, 512 * 1024 * 1024


@dataclass(frozen=True)
class Facts:
    rows: int
    dimension: int
    dtype: str
    offset: int


def npy_facts(path: str | Path, rows: int | None = None, dimension: int | None = None, max_bytes: int = MAX_BYTES) -> Facts:
    """What the header of a file says, whose numbers aren't read; ValueError with all that is wrong.

    The file must be a matrix in C order of 32- or 64-bit floats, of 1 to 8192 columns, as large as its
    header says and no larger than ``max_bytes``.
    """
    size = Path(path).stat().st_size
    with open(path, "rb") as f:
        version = np.lib.format.read_magic(f)
        if version not in ((1, 0), (2, 0)):
            raise ValueError(f"{path}: version {version} isn't read")
        reader = np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0
        shape, fortran, dtype = reader(f)
        offset = f.tell()
    wrong = {
        f"{len(shape)} axes": len(shape) != 2,
        "columns first": fortran,
        f"numbers of type {dtype}": dtype.str not in ("<f4", "<f8"),
        f"{size} bytes": size > max_bytes or size - offset != math.prod(shape) * dtype.itemsize,
        f"shape {shape}": len(shape) == 2 and (not 1 <= shape[1] <= MAX_DIMENSION or shape[0] != (shape[0] if rows is None else rows) or shape[1] != (shape[1] if dimension is None else dimension)),
    }
    if any(wrong.values()):
        raise ValueError(f"{path}: " + ", ".join(what for what, is_so in wrong.items() if is_so))
    return Facts(shape[0], shape[1], dtype.str, offset)


def read_npy(spark: SparkSession, path: str, rows: int | None = None, dimension: int | None = None) -> DataFrame:
    """(row, embedding): the matrix of a file that all executors can reach, each task reading its own rows."""
    facts = npy_facts(path, rows, dimension)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.memmap(path, facts.dtype, "r", facts.offset, (facts.rows, facts.dimension)) if facts.rows else np.zeros((0, facts.dimension), facts.dtype)
        for b in batches:
            at = np.asarray(b.column(0))
            numbers = pa.array(np.asarray(held[at], np.float64).ravel())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1, dtype=np.int32) * facts.dimension), numbers)], ["row", "embedding"])

    return spark.range(facts.rows).select(F.col("id").alias("row")).mapInArrow(run, "row long, embedding array<double>")
