"""Most similar vectors for every vector: NN-descent as iterative Spark joins.

The graph of neighbours starts from blocks of a few sorted orders (centroid, then signs of random
projections; the centroids are fitted on a bounded sample, every row is placed): the rows of a block
are compared with each other, and each row takes its list along to the next order. Rounds of NN-descent
then let the neighbours of every node meet each other. A list entry remembers the orders and rounds in
which it has met its node; two entries that share one have met already, so a round moves only the
vectors of nodes that still have somebody to meet. Every block has a bounded number of rows and every
list ``degree`` entries, whatever the data look like: hot topics are just many blocks, and exact copies
are one node. What moves is proportional to the rows, at every size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from querent.llm.arrowkit import binary, flat, matrix, sliced, whole_groups
from querent.plans.skew import join_on_hot_key
from querent.plans.staging import Stage, shuffle_partitions

#: Documented bounds and sizes: vectors on which centroids are fitted, centroids, rows of a block
#: that are compared with each other, rows of a partition, rows sampled for each bound between
#: partitions, entries of a neighbour list.
SAMPLE_ROWS, CENTROIDS, BLOCK_ROWS, HOME_ROWS, BOUND_ROWS, DEGREE = 8192, 128, 4096, 1 << 20, 64, 12
#: Most ids or hashes that are broadcast; more are joined by a shuffle.
CHECK_ROWS = 100_000
#: Rounds end when fewer than this share of list entries change.
LEAST_CHANGE = 0.01
#: Unit vectors in float16 give cosines within this of the exact ones.
HALF_ERROR = 5e-4
_LISTS = "nbr binary, sim binary, met binary"
#: The orders have the lower bits of ``met``; this one is for entries that a round has seen.
JOINED = 128


def _unit_rows(dims: int, exact: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            vec, ids = b.column(1), b.column(0)
            ok = np.asarray(vec.is_valid()) & np.asarray(ids.is_valid())
            sizes = np.asarray(pa.compute.list_value_length(vec).fill_null(0))
            keep = np.flatnonzero(ok & (sizes == dims))
            vec = vec.take(pa.array(keep))
            flat = vec.flatten().cast(pa.float64())
            x = np.asarray(flat.fill_null(np.nan)).reshape(len(keep), dims)
            good = np.isfinite(x).all(axis=1) & (x != 0).any(axis=1)
            keep, x = keep[good], x[good]
            x = x / np.abs(x).max(axis=1, keepdims=True) if len(x) else x
            x = x / np.sqrt((x * x).sum(axis=1, keepdims=True)) if len(x) else x
            cols = [ids.take(pa.array(keep)).cast(pa.int64()), binary(x.astype(np.float16)), *([binary(x)] if exact else [])]
            yield pa.RecordBatch.from_arrays(cols, ["id", "vec", "full"][: len(cols)])

    return run


def usable_vectors(df: DataFrame, id_col: str, vec_col: str, dims: int, exact: bool = False) -> DataFrame:
    """(id, vec): unit vectors as float16 bytes; with ``exact`` also ``full``, in double precision.

    Null ids, and vectors that are null, of another dimension, all zero or not finite, take no part.
    Vectors are divided by their largest magnitude first, so extreme lengths survive.
    """
    kind = df.schema[vec_col].dataType
    number = isinstance(kind, T.ArrayType) and isinstance(kind.elementType, (T.FloatType, T.DoubleType))
    src = df.select(F.col(id_col).cast("long").alias("id"), (F.col(vec_col) if number else F.col(vec_col).cast("array<double>")).alias("v"))
    return src.mapInArrow(_unit_rows(dims, exact), "id long, vec binary" + (", full binary" if exact else ""))


def _centroids(sample: np.ndarray, k: int, seed: int) -> np.ndarray:
    """Spherical k-means on the sample, in an order in which neighbours are similar."""
    rng = np.random.default_rng(seed)
    k = max(1, min(k, len(sample)))
    c = sample[rng.choice(len(sample), k, replace=False)]
    for _ in range(8):
        own = np.argmax(sample @ c.T, axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, own, sample)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        c = np.where(norm > 1e-6, sums / np.maximum(norm, 1e-6), c)
    left, order = np.ones(k, bool), [0]
    left[0] = False
    while left.any():
        sims = np.where(left, c @ c[order[-1]], -9)
        order.append(int(np.argmax(sims)))
        left[order[-1]] = False
    return c[order].astype(np.float32)


def _keys(x: np.ndarray, ids: np.ndarray, cents: np.ndarray, planes: np.ndarray) -> np.ndarray:
    """Sort keys: the nearest centroid, then signs of random projections of the rest, then bits of the id that split ties."""
    weights = 1 << np.arange(len(planes))[::-1]
    cell = np.argmax(x @ cents.T, axis=1)
    signs = ((x - cents[cell]) @ planes.T > 0) @ weights
    spread = ((ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48)).astype(np.int64)
    return ((cell.astype(np.int64) << len(planes)) + signs << 16) + spread


def _top(sims: np.ndarray, k: int) -> np.ndarray:
    """Columns of the k largest entries of each row, largest first."""
    k = min(k, sims.shape[1])
    at = np.argpartition(-sims, k - 1, axis=1)[:, :k] if k < sims.shape[1] else np.tile(np.arange(k), (len(sims), 1))
    return np.take_along_axis(at, np.argsort(-np.take_along_axis(sims, at, 1), axis=1, kind="stable"), 1)


def _floors(sims: np.ndarray, k: int) -> np.ndarray:
    """For each row a value that at least k of its entries reach, and not many more.

    The k-th largest of the maxima of groups of 16 columns; the groups are strided, so that the maxima
    are taken by whole rows of memory.
    """
    width = sims.shape[1] // 16
    if width <= 2 * k:
        return np.partition(sims, -k, axis=1)[:, -k] if sims.shape[1] > k else np.full(len(sims), -8, np.float32)
    maxima = sims[:, : 16 * width].reshape(len(sims), 16, width).max(axis=1)
    return np.partition(maxima, -k, axis=1)[:, -k]


class _Order:
    """One sorted order: its centroids, projections, and the bounds of its partitions; travels to the workers."""

    def __init__(self, cents: np.ndarray, planes: np.ndarray, bounds: np.ndarray) -> None:
        self.cents, self.planes, self.bounds = cents, planes, bounds

    def place(self, x: np.ndarray, ids: np.ndarray) -> list[pa.Array]:
        keys = _keys(x, ids, self.cents, self.planes)
        return [pa.array(keys), pa.array(np.searchsorted(self.bounds, keys, side="right").astype(np.int32))]


def _placed(dims: int, order: _Order):
    """Adds the sort key and the partition of an order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = matrix(b.column(1), dims, "float16").astype(np.float32)
            yield pa.RecordBatch.from_arrays([*b.columns, *order.place(x, np.asarray(b.column(0)))], ["id", "vec", "key", "part"])

    return run


def _all_keys(dims: int, orders: list[_Order]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, ids = matrix(b.column(1), dims, "float16").astype(np.float32), np.asarray(b.column(0))
            yield pa.RecordBatch.from_arrays([binary(np.stack([_keys(x, ids, o.cents, o.planes) for o in orders], 1))], ["keys"])

    return run


def _improved(x: np.ndarray, ids: np.ndarray, nbr: np.ndarray, sim: np.ndarray, met: np.ndarray, bit: int) -> None:
    """Compares all rows of a block with each other and puts the best into their lists."""
    n, k = nbr.shape
    by_id = np.argsort(ids, kind="stable")
    at = np.minimum(np.searchsorted(ids, nbr, sorter=by_id), n - 1)
    at = by_id[at]
    here = (ids[at] == nbr) & (nbr >= 0)
    met[here] |= bit
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for lo in range(0, n, 256):
        s = x[lo : lo + 256] @ x.T
        rows = np.arange(len(s))
        s[rows, rows + lo] = -9
        own = here[lo : lo + 256]
        s[np.broadcast_to(rows[:, None], own.shape)[own], at[lo : lo + 256][own]] = -9
        least = np.maximum(_floors(s, min(k, n)), np.maximum(sim[lo : lo + 256, -1], -2))
        r, c = np.divmod(np.flatnonzero(s >= least[:, None]), n)
        found.append((r + lo, c, s[r, c]))
    r, c, v = (np.concatenate(f) for f in zip(*found))
    order = np.argsort(4.0 * r - v, kind="stable")
    r, c, v = r[order], c[order], v[order]
    begin = np.flatnonzero(np.r_[True, r[1:] != r[:-1]]) if len(r) else np.zeros(0, int)
    rank = np.arange(len(r)) - np.repeat(begin, np.diff(np.r_[begin, len(r)]))
    keep = rank < k
    r, c, v, rank = r[keep], c[keep], v[keep], rank[keep]
    width = int(rank.max()) + 1 if len(rank) else 0
    more_id, more_sim, more_met = np.full((n, width), -1, np.int64), np.full((n, width), -9, np.float32), np.full((n, width), bit, np.uint8)
    more_id[r, rank], more_sim[r, rank] = ids[c], v
    every = [np.hstack(p) for p in ((nbr, more_id), (sim, more_sim), (met, more_met))]
    best = np.argsort(-every[1], axis=1, kind="stable")[:, :k]
    nbr[:], sim[:], met[:] = (np.take_along_axis(e, best, 1) for e in every)
    met[nbr < 0] = 0


def _block_lists(dims: int, k: int, rows: int, bit: int, following: _Order | None, keep_vec: bool):
    """Compares the rows of each block of consecutive rows, and places them in the following order."""

    def done(t: pa.Table) -> pa.RecordBatch:
        ids, n = np.asarray(t["id"]), t.num_rows
        x = matrix(t["vec"], dims, "float16").astype(np.float32)
        if "nbr" in t.column_names:
            nbr, sim, met = matrix(t["nbr"], k, "int64").copy(), matrix(t["sim"], k, "float32").copy(), matrix(t["met"], k, "uint8").copy()
        else:
            nbr, sim, met = np.full((n, k), -1, np.int64), np.full((n, k), -9, np.float32), np.zeros((n, k), np.uint8)
        _improved(x, ids, nbr, sim, met, bit)
        cols = {"id": pa.array(ids), "vec": t["vec"].combine_chunks(), "nbr": binary(nbr), "sim": binary(sim), "met": binary(met)}
        if isinstance(cols["vec"], pa.ChunkedArray):
            cols["vec"] = pa.concat_arrays(cols["vec"].chunks)
        if following:
            cols["key"], cols["part"] = following.place(x, ids)
        elif not keep_vec:
            del cols["vec"]
            cols |= {"worst": pa.array(sim[:, -1]), "changed": pa.array(np.full(n, k, np.int32))}
        return pa.RecordBatch.from_arrays(list(cols.values()), list(cols))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            held.append(b)
            while sum(x.num_rows for x in held) >= 2 * rows:
                t = pa.Table.from_batches(held).combine_chunks()
                yield done(t.slice(0, rows).combine_chunks())
                held = t.slice(rows).combine_chunks().to_batches()
        if held and sum(x.num_rows for x in held):
            t = pa.Table.from_batches(held).combine_chunks()
            if t.num_rows > rows:
                half = t.num_rows // 2
                yield done(t.slice(0, half).combine_chunks())
                t = t.slice(half).combine_chunks()
            yield done(t)

    return run


def _waiting(k: int):
    """(at, id, met): the entries of each node's list that some other entry of it hasn't met."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            nbr, met = matrix(b.column(1), k, "int64"), matrix(b.column(2), k, "uint8")
            real = nbr >= 0
            apart = ((met[:, :, None] & met[:, None, :]) == 0) & real[:, :, None] & real[:, None, :]
            apart[:, np.arange(k), np.arange(k)] = False
            row, col = np.nonzero(apart.any(axis=2))
            yield pa.RecordBatch.from_arrays([pa.array(np.asarray(b.column(0))[row]), pa.array(nbr[row, col]), pa.array(met[row, col].astype(np.int16))], ["at", "id", "met"])

    return run


def _ranked(node: np.ndarray, sim: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order by node, then similarity, then id; and the rank of each entry within its node."""
    order = np.lexsort((other, -sim, node))
    node = node[order]
    begin = np.flatnonzero(np.r_[True, node[1:] != node[:-1]]) if len(node) else np.zeros(0, int)
    return order, np.arange(len(node)) - np.repeat(begin, np.diff(np.r_[begin, len(node)]))


def _meet(dims: int, k: int):
    """The neighbours of a node that haven't met are compared; both learn of it if it may improve their list.

    Rows are sorted by ``at``. Each task hands on at most the k best for a node, as lists of one entry.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, "at"):
            at, ids, worst = np.asarray(t["at"]), np.asarray(t["id"]), np.asarray(t["worst"])
            met, x = np.asarray(t["met"]), matrix(t["vec"], dims, "float16").astype(np.float32)
            begin = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
            size = np.diff(np.r_[begin, len(at)])
            out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            for lo in range(0, len(begin), 2048):
                real = np.arange(k) < size[lo : lo + 2048, None]
                slot = np.where(real, begin[lo : lo + 2048, None] + np.arange(k), 0)
                rows = x[slot]
                sims = np.matmul(rows, rows.transpose(0, 2, 1))
                apart = ((met[slot][:, :, None] & met[slot][:, None, :]) == 0) & real[:, :, None] & real[:, None, :]
                apart[:, np.arange(k), np.arange(k)] = False
                g, i, j = np.nonzero(apart & (sims > worst[slot][:, :, None]))
                out.append((ids[slot[g, i]], ids[slot[g, j]], sims[g, i, j]))
            node, other, sim = (np.concatenate(o) for o in zip(*out))
            once = np.lexsort((other, node))
            node, other, sim = node[once], other[once], sim[once]
            first = np.ones(len(node), bool)
            first[1:] = (node[1:] != node[:-1]) | (other[1:] != other[:-1])
            node, other, sim = node[first], other[first], sim[first]
            order, rank = _ranked(node, sim, other)
            order = order[rank < k]
            if len(order):
                yield pa.RecordBatch.from_arrays([pa.array(node[order]), binary(other[order, None]), binary(sim[order, None].astype(np.float32))], ["id", "nbr", "sim"])

    return run


def _merge_lists(k: int):
    """The k best distinct entries of each node; ``changed``: entries that its list didn't have before.

    Rows are sorted by id; those with ``met`` are the lists as they were, the others what a round found.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, "id"):
            ids, held = np.asarray(t["id"]), np.asarray(t["met"].is_valid())
            at = np.flatnonzero(held)
            rows = t.take(pa.array(at)).combine_chunks()
            nbr, sim, met = matrix(rows["nbr"], k, "int64").copy(), matrix(rows["sim"], k, "float32").copy(), matrix(rows["met"], k, "uint8").copy()
            met[nbr >= 0] |= JOINED
            own, changed = ids[at], np.zeros(len(at), np.int32)
            news = t.filter(pa.array(~held)).combine_chunks()
            row = np.searchsorted(own, np.asarray(news["id"]))
            other, new_sim = flat(news["nbr"], "int64")[0], flat(news["sim"], "float32")[0]
            fresh = ~(nbr[row] == other[:, None]).any(axis=1)
            row, other, new_sim = row[fresh], other[fresh], new_sim[fresh]
            once = np.unique(np.stack([row, other], 1), axis=0, return_index=True)[1]
            row, other, new_sim = row[once], other[once], new_sim[once]
            order, rank = _ranked(row, new_sim, other)
            row, other, new_sim = row[order][rank < k], other[order][rank < k], new_sim[order][rank < k]
            touched, row = np.unique(row, return_inverse=True)
            width = int(rank[rank < k].max()) + 1 if len(row) else 0
            more_id, more_sim = np.full((len(touched), width), -1, np.int64), np.full((len(touched), width), -9, np.float32)
            more_id[row, rank[rank < k]], more_sim[row, rank[rank < k]] = other, new_sim
            every = [np.hstack(p) for p in ((nbr[touched], more_id), (sim[touched], more_sim), (met[touched], np.zeros(more_id.shape, np.uint8)))]
            best = np.argsort(-every[1], axis=1, kind="stable")[:, :k]
            nbr[touched], sim[touched], met[touched] = (np.take_along_axis(e, best, 1) for e in every)
            changed[touched] = ((best >= k) & (nbr[touched] >= 0)).sum(axis=1)
            cols = [pa.array(own), binary(nbr), binary(sim), binary(met), pa.array(sim[:, -1]), pa.array(changed)]
            yield from sliced(pa.table(cols, ["id", "nbr", "sim", "met", "worst", "changed"]), 20000)

    return run


class NeighbourGraph:
    """The graph: ``nodes`` (id, vec), ``lists`` (id, nbr, sim) and ``copies`` (id, rep); ``rounds`` has the share of entries that each round changed."""

    def __init__(self, stage: Stage, nodes: DataFrame, lists: DataFrame, copies: DataFrame, degree: int, dims: int, rounds: list[float]) -> None:
        self.stage, self.nodes, self.lists, self.copies, self.degree, self.dims, self.rounds = stage, nodes, lists, copies, degree, dims, rounds

    def edges(self, k: int, least: float = -2.0) -> DataFrame:
        """(id, other, sim, sure): the k best neighbours of every node (of every class of copies) from ``least`` on.

        Half precision can't tell entries apart that lie within its error of the k-th; where the list
        goes on there, all of them are given and ``sure`` is false. It is false as well within the
        error of ``least``.
        """
        degree = self.degree

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                nbr, sim = matrix(b.column(1), degree, "int64"), matrix(b.column(2), degree, "float32")
                last = sim[:, min(k, degree) - 1][:, None]
                near = np.abs(sim - last) <= 2 * HALF_ERROR
                open_ = near[:, k:].any(axis=1)[:, None] if k < degree else np.zeros((len(sim), 1), bool)
                given = ((np.arange(degree) < k) | near & open_) & (nbr >= 0) & (sim >= least - HALF_ERROR)
                sure = ~(near & open_) & (np.abs(sim - least) > HALF_ERROR)
                row, col = np.nonzero(given)
                yield pa.RecordBatch.from_arrays([pa.array(np.asarray(b.column(0))[row]), pa.array(nbr[row, col]), pa.array(np.minimum(sim[row, col], 1.0).astype(np.float64)), pa.array(sure[row, col])], ["id", "other", "sim", "sure"])

        return self.lists.select("id", "nbr", "sim").mapInArrow(run, "id long, other long, sim double, sure boolean")


def _cosines(dims: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = matrix(b.column(2), dims, "float64"), matrix(b.column(3), dims, "float64")
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(np.einsum("ij,ij->i", x, y))], ["id", "other", "sim"])

    return run


def _settled(graph: NeighbourGraph, stored: DataFrame, k: int, least: float) -> DataFrame:
    """(id, other, sim): the edges, with exact similarities where half precision doesn't decide.

    ``stored``: (id, vec, full), the vectors in full; of rows with one id, that of the graph counts.
    """
    edges = graph.stage.write(graph.edges(k, least), "edges")
    unsure = edges.filter(~F.col("sure")).select("id", "other")
    wanted = graph.stage.write(unsure.select(F.explode(F.array("id", "other")).alias("id")).distinct(), "wanted")
    known = graph.nodes.join(_small(wanted), "id", "left_semi")
    full = stored.join(_small(wanted), "id", "left_semi").join(known, ["id", "vec"], "left_semi").groupBy("id").agg(F.min("full").alias("full"))
    full = graph.stage.write(full, "full")
    pairs = unsure.join(full, "id").join(full.select(F.col("id").alias("other"), F.col("full").alias("full2")), "other").select("id", "other", "full", "full2")
    return edges.filter("sure").select("id", "other", "sim").unionByName(pairs.mapInArrow(_cosines(graph.dims), "id long, other long, sim double"))


def most_similar(graph: NeighbourGraph, k: int = 5, least: float | None = None, stored: DataFrame | None = None) -> DataFrame:
    """(id, other, rank, sim): the k most similar other vectors of every vector, largest first, ties by id.

    Copies take their part: each is a neighbour of the others, and of all to which its class is near.
    A class hands on its k + 1 smallest ids, which is all that a list of k can hold. With ``least``,
    only entries of at least that similarity. With ``stored`` (``usable_vectors`` with ``exact``), what
    half precision can't decide is decided on the vectors in full.
    """
    low = -2.0 if least is None else least
    best = graph.edges(graph.degree, low).select("id", "other", "sim") if stored is None else _settled(graph, stored, k, low)
    best = best.filter(F.col("sim") >= low)
    sizes = graph.copies.groupBy("rep").agg(F.count(F.lit(1)).alias("n"))
    members = _members(graph.copies, k)
    spread = _spread(best, members)
    within = members.select(F.col("rep").alias("id"), F.explode("members").alias("other"), F.lit(1.0).alias("sim"))
    ranked = Window.partitionBy("id").orderBy(F.desc("sim"), "other")
    by_class = spread.unionByName(within).withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= k + 1)
    single = by_class.join(members.select(F.col("rep").alias("id")), "id", "left_anti").filter(F.col("rank") <= k)
    # a class has one list, whatever its size; its members take it and leave themselves out
    lists = by_class.join(sizes.withColumnRenamed("rep", "id"), "id").groupBy(F.col("id").alias("rep")).agg(F.first("n").alias("n"), F.array_sort(F.collect_list(F.struct("rank", "other", "sim"))).alias("list"))
    copied = join_on_hot_key(graph.copies, lists, "rep", CHECK_ROWS, "n")
    others = F.slice(F.filter("list", lambda e: e["other"] != F.col("id")), 1, k)
    copied = copied.select("id", F.posexplode(others).alias("at", "e")).select("id", "e.other", (F.col("at") + 1).alias("rank"), "e.sim")
    return single.select("id", "other", "rank", "sim").unionByName(copied)


def _members(copies: DataFrame, k: int) -> DataFrame:
    """(rep, members): the k + 1 smallest ids of each class of copies."""
    smallest = Window.partitionBy("rep").orderBy("id")
    return copies.withColumn("_n", F.row_number().over(smallest)).filter(F.col("_n") <= k + 1).groupBy("rep").agg(F.sort_array(F.collect_list("id")).alias("members"))


def _spread(best: DataFrame, members: DataFrame) -> DataFrame:
    """(id, other, sim) with each class of copies replaced by its members."""
    return best.join(members.withColumnRenamed("rep", "other"), "other", "left").select("id", F.explode(F.coalesce("members", F.array("other"))).alias("other"), "sim")


#: Nodes from which a search begins, the best of them that it expands first, and the nodes it keeps.
ENTRIES, STARTS, BEAM = 1024, 8, 64


def _start(dims: int, ids: np.ndarray, points: np.ndarray, starts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            q = matrix(b.column(1), dims, "float16").astype(np.float32)
            sims = q @ points.T
            top = _top(sims, starts) if len(q) else np.zeros((0, 0), int)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.asarray(b.column(0)), top.shape[1])), pa.array(ids[top].ravel()), pa.array(np.take_along_axis(sims, top, 1).ravel().astype(np.float32))], ["query", "id", "sim"])

    return run


def _compare(dims: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            q, x = (matrix(b.column(i), dims, "float16").astype(np.float32) for i in (2, 3))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(np.einsum("ij,ij->i", q, x).astype(np.float32))], ["query", "id", "sim"])

    return run


def _entries(degree: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            nbr = matrix(b.column(1), degree, "int64").ravel()
            query = np.repeat(np.asarray(b.column(0)), degree)
            pairs = np.unique(np.stack([query[nbr >= 0], nbr[nbr >= 0]], 1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["query", "id"])

    return run


def greedy_search(graph: NeighbourGraph, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding", beam: int = BEAM) -> DataFrame:
    """(query, id, rank, sim): the k most similar vectors of the graph for each query, itself left out.

    Each search keeps its ``beam`` best nodes and expands those not yet expanded, all searches at once,
    until no beam has any; a step is three joins on ids. Unusable queries give no rows.
    """
    stage, dims, degree = graph.stage, graph.dims, graph.degree
    asked = stage.write(usable_vectors(queries, id_col, vec_col, dims).groupBy("id").agg(F.first("vec").alias("q")).withColumnRenamed("id", "query"), "queries")
    first = graph.nodes.withColumn("_o", F.xxhash64("id", F.lit(23))).orderBy("_o", "id").limit(ENTRIES).select("id", "vec").collect()
    if not first:
        return asked.select("query", F.lit(None).cast("long").alias("id"), F.lit(0).alias("rank"), F.lit(0.0).alias("sim")).limit(0)
    kept = asked.select("query", "q").mapInArrow(_start(dims, np.array([r["id"] for r in first]), _decode(first, dims), STARTS), "query long, id long, sim float")
    kept = stage.write(kept.withColumn("open", F.lit(True)), "beam")
    best = Window.partitionBy("query").orderBy(F.desc("sim"), "id")
    while kept.filter("open").limit(1).count():
        lists = graph.lists.select("id", "nbr")
        reached = kept.filter("open").select("query", "id").join(lists, "id").select("query", "nbr").mapInArrow(_entries(degree), "query long, id long").distinct()
        fresh = reached.join(kept.select("query", "id"), ["query", "id"], "left_anti")
        seen = fresh.join(graph.nodes.select("id", "vec"), "id").join(asked, "query").select("query", "id", "q", "vec").mapInArrow(_compare(dims), "query long, id long, sim float")
        every = kept.withColumn("open", F.lit(False)).unionByName(seen.withColumn("open", F.lit(True)))
        after = stage.write(every.withColumn("_r", F.row_number().over(best)).filter(F.col("_r") <= beam).drop("_r"), "beam")
        stage.drop(kept)
        kept = after
    found = _spread(kept.select(F.col("query").alias("id"), F.col("id").alias("other"), F.col("sim").cast("double").alias("sim")), _members(graph.copies, k))
    ranked = Window.partitionBy("id").orderBy(F.desc("sim"), "other")
    top = found.filter("id <> other").withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= k)
    return top.select(F.col("id").alias("query"), F.col("other").alias("id"), "rank", F.least("sim", F.lit(1.0)).alias("sim"))


def similar_pairs(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", dims: int = 64, k: int = 5, least: float = 0.90, **params) -> DataFrame:
    """(vec_lo, vec_hi): pairs with cosine >= ``least`` of which one is among the k most similar of the other.

    The pairs come from the neighbour graph; what its half-precision vectors can't decide, at the line
    or at the k-th place, is decided on the vectors as stored.
    """
    graph = build_graph(df, id_col, vec_col, dims, **params)
    near = most_similar(graph, k, least, usable_vectors(df, id_col, vec_col, dims, exact=True))
    return near.select(F.least("id", "other").alias("vec_lo"), F.greatest("id", "other").alias("vec_hi")).distinct()


def _decode(rows: list, dims: int) -> np.ndarray:
    return np.frombuffer(b"".join(bytes(r["vec"]) for r in rows), np.float16).reshape(len(rows), dims).astype(np.float32)


def _small(df: DataFrame) -> DataFrame:
    """Broadcast if it has at most ``CHECK_ROWS`` rows, which is counted; joined by a shuffle beyond."""
    return F.broadcast(df) if df.count() <= CHECK_ROWS else df


def _sampled(nodes: DataFrame, total: int, rows: int, seed: int) -> DataFrame:
    """About ``rows`` nodes (all, if there are no more), told by a hash of the id."""
    steps = 1 << 40
    return nodes if total <= rows else nodes.filter(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(steps)) < int(steps * rows / total))


def _distinct_nodes(stage: Stage, usable: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, vec), one for each vector, and copies (id, rep): the ids of vectors that have several.

    Repeated rows of an id count once; of different vectors under one id that with the smallest hash counts.
    """
    raw = stage.write(usable.withColumn("h", F.xxhash64("vec")).withColumn("row", F.monotonically_increasing_id()), "vectors")
    strays = stage.write(raw.groupBy("id").agg(F.min("h").alias("own"), F.max("h").alias("last")).filter("own <> last").select("id", "own"), "strays")
    kept = raw if strays.isEmpty() else raw.join(_small(strays), "id", "left").filter("own is null or h = own").drop("own")
    # copies are looked for by hash; vectors move only where a hash occurs twice
    twice = stage.write(kept.groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "twice")
    alike = kept.join(_small(twice.select("h")), "h")
    classes = alike.groupBy("h", "vec").agg(F.min(F.struct("id", "row")).alias("first"), F.max("id").alias("last"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    classes = stage.write(classes.select("h", "vec", F.col("first.id").alias("rep"), F.col("first.row").alias("own"), "last"), "classes")
    marked = stage.write(alike.join(_small(classes), ["h", "vec"]).select("id", "row", "rep", "own", "last"), "alike")
    copies = stage.write(marked.filter("rep <> last").select("id", "rep").distinct(), "copies")
    nodes = stage.write(kept.join(_small(marked.filter("row <> own").select("row")), "row", "left_anti").select("id", "vec"), "nodes")
    stage.drop(raw, strays, twice, classes, marked)
    return nodes, copies


def _round(stage: Stage, nodes: DataFrame, lists: DataFrame, dims: int, degree: int, shape: str) -> DataFrame:
    """The lists after the neighbours of every node have met."""
    asked = lists.select("id", "nbr", "met").mapInArrow(_waiting(degree), "at long, id long, met short")
    known = nodes.join(lists.select("id", "worst"), "id")
    got = asked.join(known, "id").select("at", "id", "met", "worst", "vec").repartition("at").sortWithinPartitions("at")
    found = got.mapInArrow(_meet(dims, degree), "id long, nbr binary, sim binary")
    both = lists.select("id", "nbr", "sim", "met").unionByName(found.withColumn("met", F.lit(None).cast("binary")))
    return stage.write(both.repartition("id").sortWithinPartitions("id").mapInArrow(_merge_lists(degree), shape), "lists")


def build_graph(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", dims: int = 64, degree: int = DEGREE, orders: int = 5, max_rounds: int = 30, seed: int = 7, block_rows: int = BLOCK_ROWS, home_rows: int = HOME_ROWS) -> NeighbourGraph:
    """Builds the neighbour graph of all usable vectors by NN-descent.

    Repeated ids count once. Nulls and unusable vectors take no part (``usable_vectors``); an empty
    table or a single vector gives empty lists; vectors equal to float16 precision are one node. Rounds
    go on until fewer than ``LEAST_CHANGE`` of the entries change; should ``max_rounds`` not suffice, it raises.
    """
    if not 1 <= orders <= 7:
        raise ValueError("orders must be from 1 to 7")
    spark: SparkSession = df.sparkSession
    stage = Stage(spark, "neighbours")
    nodes, copies = _distinct_nodes(stage, usable_vectors(df, id_col, vec_col, dims))
    total = nodes.count()
    # as many parts as the cluster has use for, but none smaller than a block, and none larger than home_rows
    parts = max(1, min(shuffle_partitions(spark), total // block_rows), -(-total // home_rows))

    fitted = _sampled(nodes, total, 2 * SAMPLE_ROWS, seed).withColumn("_o", F.xxhash64("id", F.lit(seed + 1))).orderBy("_o", "id").limit(SAMPLE_ROWS).select("vec").collect()
    points = _decode(fitted, dims) if fitted else np.zeros((1, dims), np.float32)
    rng = np.random.default_rng(seed)
    made = [_Order(_centroids(points, CENTROIDS, seed + n), rng.standard_normal((14, dims)).astype(np.float32), np.zeros(0, np.int64)) for n in range(orders)]
    told = _sampled(nodes, total, BOUND_ROWS * parts, seed + 2).mapInArrow(_all_keys(dims, made), "keys binary").collect() if parts > 1 else []
    keys = np.sort(np.frombuffer(b"".join(bytes(r["keys"]) for r in told), np.int64).reshape(-1, orders), axis=0)
    for n, order in enumerate(made):
        order.bounds = keys[[len(keys) * i // parts for i in range(1, parts)], n] if len(keys) else keys[:0, 0]

    shape = f"id long, {_LISTS}, worst float, changed int"
    rows, staged = nodes.mapInArrow(_placed(dims, made[0]), "id long, vec binary, key long, part int"), None
    for n in range(orders):
        following = made[n + 1] if n + 1 < orders else None
        laid = rows.repartitionById(parts, "part").sortWithinPartitions("key", "id")
        rows = laid.mapInArrow(_block_lists(dims, degree, block_rows, 1 << n, following, bool(following)), f"id long, vec binary, {_LISTS}, key long, part int" if following else shape)
        # each order is written, which bounds what a lost executor costs and what is on disk at once
        after = stage.write(rows, "lists")
        stage.drop(staged)
        rows = staged = after
    lists = staged

    rounds: list[float] = []
    while not rounds or rounds[-1] >= LEAST_CHANGE:
        if len(rounds) == max_rounds:
            raise RuntimeError(f"the lists did not settle in {max_rounds} rounds: shares of changed entries {rounds}")
        after = _round(stage, nodes, lists, dims, degree, shape)
        stage.drop(lists)
        lists = after
        rounds.append((lists.agg(F.sum("changed")).first()[0] or 0) / max(1, degree * total))
    return NeighbourGraph(stage, nodes, lists.drop("changed", "worst"), copies, degree, dims, rounds)
