"""Filling fixed-capacity containers along a space-filling curve.

Each text is a hashed vector (every token id has a fixed random direction) projected to a few
dimensions; its place on a Hilbert curve orders the texts so that similar ones are neighbours. The
texts are range-partitioned along the curve and packed where they lie, in windows of neighbours, best
fit first; containers with room stay open for the next windows.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from querent.llm.tokens import VOCABULARY, encode
from querent.plans.staging import Stage
from querent.plans.workers import once, ship

DIMENSIONS, BITS = 3, 10
#: Items that are packed together, and containers that stay open for the next window.
WINDOW, OPEN = 4096, 1024


def _directions(size: int, seed: int) -> np.ndarray:
    return once(("directions", size, seed), lambda: np.random.default_rng(seed).standard_normal((size, DIMENSIONS)).astype(np.float32))


def hilbert_keys(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Places on the Hilbert curve of integer points (n, dims), by the transpose form of the curve."""
    x = points.astype(np.int64).T.copy()
    dims = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(dims):
            high = (x[i] & q) > 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(high, x[0] ^ p, x[0] ^ swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    t = np.zeros(x.shape[1], np.int64)
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where(x[dims - 1] & q, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    key = np.zeros(x.shape[1], np.int64)
    for bit in range(bits - 1, -1, -1):
        for i in range(dims):
            key = key << 1 | (x[i] >> bit & 1)
    return key


def _measure(path: str, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _directions(1 << 16, seed)
        for b in batches:
            sizes, points = [], []
            for text in b.column(1).to_pylist():
                ids = np.asarray(encode(text, path), np.int64)
                sizes.append(len(ids))
                own = np.unique(ids) & 0xFFFF
                points.append(table[own].sum(axis=0) / np.sqrt(max(1, len(own))))
            at = np.clip((np.array(points).reshape(-1, DIMENSIONS) + 4) / 8 * (1 << BITS), 0, (1 << BITS) - 1).astype(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.array(sizes, np.int64)), pa.array(hilbert_keys(at))], ["doc", "tokens", "place"])

    return run


class Packer:
    """Packs items of one capacity in windows; ``take`` and ``finish`` return (item, container) pairs."""

    def __init__(self, capacity: int, number) -> None:
        self.capacity, self.number = capacity, number
        self.open: list[tuple[int, int]] = []  # (room, container), by room
        self.held: list[tuple[int, object]] = []

    def take(self, size: int, item: object) -> list[tuple[object, int]]:
        self.held.append((size, item))
        return self.finish() if len(self.held) >= WINDOW else []

    def finish(self) -> list[tuple[object, int]]:
        """Best fit, largest item first, over the window and the open containers."""
        out = []
        for size, item in sorted(self.held, key=lambda x: -x[0]):
            at = bisect_left(self.open, (size, -1))
            room, box = self.open.pop(at) if at < len(self.open) else (self.capacity, self.number())
            out.append((item, box))
            if room > size:
                insort(self.open, (room - size, box))
        self.held = []
        if len(self.open) > OPEN:
            self.open = self.open[-OPEN:]
        return out


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part = TaskContext.get().partitionId()
    n = 0

    def number() -> int:
        nonlocal n
        n += 1
        return (part << 40) + n

    def rows(pairs: list, kind: pa.DataType) -> pa.RecordBatch:
        cols = list(zip(*[(profile, box, doc, piece, a, e) for (profile, doc, piece, a, e), box in pairs])) or [[]] * 6
        kinds = [pa.string(), pa.int64(), kind, pa.int64(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds)], ["profile", "container_id", "doc", "piece", "tok_start", "tok_end"])

    packer, now, kind = None, None, None
    for b in batches:
        out = []
        kind = b.schema.field(2).type
        for profile, capacity, doc, tokens in zip(*(c.to_pylist() for c in b.columns)):
            if (profile, capacity) != now:
                out += packer.finish() if packer else []
                packer, now = Packer(capacity, number), (profile, capacity)
            whole = tokens // capacity if tokens > capacity else 0
            for i in range(whole):
                out.append(((profile, doc, i, i * capacity, (i + 1) * capacity), number()))
            if tokens > whole * capacity:
                out += packer.take(tokens - whole * capacity, (profile, doc, whole, whole * capacity, tokens))
        if out:
            yield rows(out, kind)
    if packer:
        yield rows(packer.finish(), kind)


def measured_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, seed: int = 5) -> DataFrame:
    """(doc, tokens, place): token count and place on the curve of every text that isn't null or empty."""
    kind = df.schema[id_col].dataType.simpleString()
    given = df.select(F.col(id_col).alias("doc"), F.col(text_col).cast("string").alias("text")).filter("text is not null and text <> ''")
    return given.mapInArrow(_measure(ship(df.sparkSession, vocabulary), seed), f"doc {kind}, tokens long, place long")


def pack_texts(df: DataFrame, profiles: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """(profile, container_id, doc, piece, tok_start, tok_end): where each text goes, for each capacity.

    A text that alone exceeds the capacity is cut into full pieces and a rest, no other is cut. Each row
    of the input is an item (repeated ids are repeated items); null and empty texts have no tokens and
    take no part; profiles without name or with a capacity that is null or below 1 are left out.
    """
    stage = Stage(df.sparkSession, "packing")
    kind = df.schema[id_col].dataType.simpleString()
    sizes = stage.write(measured_texts(df, id_col, text_col, vocabulary), "sizes")
    usable = profiles.filter("profile is not null and capacity_tokens >= 1").select(F.col("profile").cast("string").alias("profile"), F.col("capacity_tokens").cast("long").alias("capacity")).distinct()
    listed = usable.agg(F.array_sort(F.collect_list(F.struct("profile", "capacity"))).alias("x")).first()["x"]
    wanted = F.array(*[F.struct(F.lit(r["profile"]).alias("profile"), F.lit(r["capacity"]).cast("long").alias("capacity")) for r in listed])
    if not listed:
        sizes, wanted = sizes.limit(0), F.array(F.struct(F.lit("").alias("profile"), F.lit(1).cast("long").alias("capacity")))
    each = sizes.select("doc", "tokens", "place", F.explode(wanted).alias("x")).select("x.profile", "x.capacity", "doc", "tokens", "place")
    laid = each.repartitionByRange("profile", "place", "doc").sortWithinPartitions("profile", "place", "doc", "tokens").select("profile", "capacity", "doc", "tokens")
    return laid.mapInArrow(_pack, f"profile string, container_id long, doc {kind}, piece long, tok_start long, tok_end long")


def fill_report(packed: DataFrame, profiles: DataFrame) -> DataFrame:
    """(profile, containers, tokens, fill): how full the containers of each profile are."""
    boxes = packed.groupBy("profile", "container_id").agg(F.sum(F.col("tok_end") - F.col("tok_start")).alias("tokens"))
    sums = boxes.groupBy("profile").agg(F.count(F.lit(1)).alias("containers"), F.sum("tokens").alias("tokens"))
    return sums.join(profiles.select("profile", "capacity_tokens").distinct(), "profile").select("profile", "containers", "tokens", (F.col("tokens") / (F.col("containers") * F.col("capacity_tokens"))).alias("fill"))
