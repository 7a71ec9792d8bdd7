"""Splits that keep related records together: components, then largest-differencing balance."""

from __future__ import annotations

import heapq
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from querent.plans.skew import global_rank, join_on_hot_key
from querent.plans.staging import Stage

#: Equal bins that the components are balanced into before whole bins go to splits.
BINS = 200
#: Rounds after which the component search gives up; each at least halves the height of the trees.
MAX_ROUNDS = 60
#: Rows of one key from which on they stay where they are and what is known of the key is broadcast.
HOT_ROWS = 100_000


def tidy_id(value: Column) -> Column:
    """Outer white space removed, case ignored."""
    return F.lower(F.regexp_replace(value.cast("string"), r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", ""))


def connected_components(edges: DataFrame, stage: Stage, max_rounds: int = MAX_ROUNDS) -> DataFrame:
    """(node, root): the smallest node of each node's component, for all nodes of ``edges`` (a, b).

    Alternates the large-star and small-star steps, whose only aggregate over a node's edges is a
    minimum (combined map-side), until nothing changes; each round is a written table. Nulls take no part.
    """
    e = edges.filter("a is not null and b is not null")
    nodes = stage.write(e.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "nodes")
    e = stage.write(e.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    mark = None
    for _ in range(max_rounds):
        # large star: every neighbour that is larger than the node hangs under the node's smallest neighbour
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")).withColumn("m", F.least("u", "m"))
        hung = join_on_hot_key(both, least, "u", HOT_ROWS, "n").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = stage.write(hung.filter("u <> v").distinct(), "large")
        # small star: every smaller neighbour, and the node, hang under the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
        small = join_on_hot_key(large, low, "u", HOT_ROWS, "n").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        after = stage.write(small, "stars")
        now = after.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        stage.drop(e, large)
        e = after
        if mark == tuple(now):
            break
        mark = tuple(now)
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return nodes.join(e.select(F.col("u").alias("node"), F.col("v").alias("_m")), "node", "left").select("node", F.coalesce("_m", "node").alias("root"))


def related_groups(queries: DataFrame, corpus: DataFrame, stage: Stage) -> DataFrame:
    """(query_id, group_id, members): each query id, the smallest id of its group, and how many ids that has.

    Ids are tied if they name the same document, or documents joined by ``superseded_by``. Document ids
    compare without outer white space and case; null elements don't count, nor do rows without query_id.
    """
    named = queries.filter("query_id is not null").select("query_id", F.explode_outer("relevant_ids").alias("d")).select("query_id", tidy_id(F.col("d")).alias("doc")).distinct()
    named = stage.write(named, "named")
    replaced = corpus.select(tidy_id(F.col("doc_id")).alias("a"), tidy_id(F.col("superseded_by")).alias("b")).filter("a is not null and b is not null and b <> ''")
    # of each id's documents the smallest stands for the id; the others are tied to it
    first = named.filter("doc is not null").groupBy("query_id").agg(F.min("doc").alias("own"))
    ties = named.filter("doc is not null").join(first, "query_id").select(F.col("own").alias("a"), F.col("doc").alias("b")).distinct()
    roots = connected_components(ties.unionByName(replaced), stage)
    # a document that many ids name, and a group that holds many, keep their rows where they are
    owned = roots.withColumnRenamed("node", "own").join(first.groupBy("own").agg(F.count(F.lit(1)).alias("n")), "own")
    placed = stage.write(join_on_hot_key(first, owned, "own", HOT_ROWS, "n").select("query_id", "root"), "placed")
    group = placed.groupBy("root").agg(F.min("query_id").alias("group_id"), F.count(F.lit(1)).alias("members"))
    tied = join_on_hot_key(placed, group, "root", HOT_ROWS, "members").select("query_id", "group_id", "members")
    alone = named.groupBy("query_id").agg(F.count("doc").alias("n")).filter("n = 0").select("query_id", F.col("query_id").alias("group_id"), F.lit(1).cast("long").alias("members"))
    return tied.unionByName(alone)


@dataclass
class Allocation:
    """How many groups of each weight go to each bin, and which split each bin belongs to."""

    runs: list[tuple[int, int, int, int]]  # weight, bin, first rank, rank after the last
    split_of: dict[int, str]


def _equal(weight: int, count: int, bins: int) -> list[tuple[int, list]]:
    """What differencing makes of equal groups: every bin has the same number of them, or one more."""
    each, more = divmod(count, bins)
    return [(weight * (each + extra), [(weight, each + extra)]) for extra, n in ((0, bins - more), (1, more)) for _ in range(n)]


def balance(histogram: dict[int, int], shares: dict[str, float], bins: int = BINS) -> Allocation:
    """Largest differencing over a histogram of group weights, then whole bins to splits.

    The k-way rule: the two partial solutions with the largest spread are merged, the heaviest bins of
    one onto the lightest of the other. Groups of equal weight are merged with each other first, which
    gives one partial solution for each weight; with N rows there are fewer than sqrt(2 N).
    """
    total = sum(w * c for w, c in histogram.items())
    bins = max(1, min(bins, sum(histogram.values())))
    heap: list[tuple[int, int, list[tuple[int, list]]]] = []
    for n, w in enumerate(sorted(histogram, reverse=True)):
        own = _equal(w, histogram[w], bins)
        heap.append((own[0][0] - own[-1][0], n, own))
    heapq.heapify(heap)
    n = len(heap)
    while len(heap) > 1:
        (_, _, x), (_, _, y) = heapq.heappop(heap), heapq.heappop(heap)
        merged = sorted(((a + c, [b, d]) for (a, b), (c, d) in zip(x, reversed(y))), key=lambda p: p[0])
        n += 1
        heapq.heappush(heap, (merged[0][0] - merged[-1][0], n, merged))
    loads = heap[0][2] if heap else [(0, [])] * bins

    counts: list[dict[int, int]] = []
    for _, held in loads:
        own: dict[int, int] = {}
        todo = [held]
        while todo:
            for x in todo.pop():
                if isinstance(x, list):
                    todo.append(x)
                elif x[1]:
                    own[x[0]] = own.get(x[0], 0) + x[1]
        counts.append(own)
    left = {s: share * total for s, share in sorted(shares.items())}
    split_of = {}
    for b in sorted(range(bins), key=lambda b: (-loads[b][0], b)):
        split = max(left, key=lambda s: (left[s], s))
        split_of[b] = split
        left[split] -= loads[b][0]
    runs, upto = [], {}
    for b in range(bins):
        for w, c in sorted(counts[b].items()):
            runs.append((w, b, upto.get(w, 0), upto.get(w, 0) + c))
            upto[w] = upto.get(w, 0) + c
    return Allocation(runs, split_of)


def assign_splits(queries: DataFrame, corpus: DataFrame, plan: DataFrame, seed: int = 11, bins: int = BINS) -> DataFrame:
    """(query_id, group_id, members, split_name): every query id's split, near the shares of ``plan``, groups whole.

    The weight of a group is its number of rows. Only the histogram of weights reaches the driver: with
    N rows it has fewer than sqrt(2 N) entries. Groups of one weight are told apart by a seeded order.
    Negative or null shares count as 0; shares are scaled to sum 1.
    """
    spark = queries.sparkSession
    stage = Stage(spark, "splits")
    groups = related_groups(queries, corpus, stage)
    rows = queries.filter("query_id is not null").groupBy("query_id").agg(F.count(F.lit(1)).alias("rows"))
    groups = stage.write(groups.join(rows, "query_id"), "groups")
    weights = groups.groupBy("group_id").agg(F.sum("rows").alias("weight"))
    weights = stage.write(weights.withColumn("order", F.xxhash64("group_id", F.lit(seed))), "weights")
    histogram = {r["weight"]: r["count"] for r in weights.groupBy("weight").count().collect()}
    shares = {r["split_name"]: max(0.0, r["target_share"] or 0.0) for r in plan.filter("split_name is not null").collect()}
    whole = sum(shares.values()) or 1.0
    made = balance(histogram, {s: x / whole for s, x in shares.items()} or {"train": 1.0}, bins)
    table = [(w, a, b, made.split_of[n]) for w, n, a, b in made.runs]
    runs = spark.createDataFrame(table, "weight bigint, first bigint, beyond bigint, split_name string")
    ranked = global_rank(stage, weights, ["weight"], ["order", "group_id"])
    placed = ranked.join(F.broadcast(runs), "weight").filter("rank >= first and rank < beyond").select("group_id", "split_name")
    named = placed.join(groups.groupBy("group_id").agg(F.max("members").alias("size")), "group_id")
    return join_on_hot_key(groups, named, "group_id", HOT_ROWS, "size").select("query_id", "group_id", "members", "split_name")
