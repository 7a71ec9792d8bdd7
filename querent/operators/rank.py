"""Rankings: stable top-k, enumeration, fusion, diversity, batches."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from querent.functions.text import check_k

#: Scores that agree to this many digits tie, whatever order they were summed in.
DIGITS = 9


def rank_in_query(scored: DataFrame, k: int | None = None, query: str = "query_id", doc: str = "doc_id", score: str = "score") -> DataFrame:
    """Adds ``rank`` by (score descending, id ascending) within each query; only the first k with ``k``."""
    order = Window.partitionBy(query).orderBy(F.desc(F.round(score, DIGITS)), doc)
    ranked = scored.withColumn("rank", F.row_number().over(order))
    return ranked if k is None else ranked.filter(F.col("rank") <= check_k(k))


def stable_top_k(scored: DataFrame, k: int, doc: str = "doc_id", score: str = "score") -> DataFrame:
    """The k best of one ranking; plans as TakeOrderedAndProject."""
    return scored.orderBy(F.desc(score), doc).limit(check_k(k))


def rank_enumerate(df: DataFrame, ids: str = "ranked_ids") -> DataFrame:
    """One row an element, with its 1-based rank."""
    others = [c for c in df.columns if c != ids]
    return df.select(*others, F.posexplode(ids).alias("_p", "doc_id")).withColumn("rank", F.col("_p") + 1).drop("_p")


def reciprocal_rank_fusion(rankings: list[DataFrame], weights: list[float] | None = None, rank_constant: float = 60, k: int = 5) -> DataFrame:
    """(query_id, doc_id, score, rank): sum of weight / (constant + rank) over the rankings.

    A component of weight 0 contributes no ids. Negative or non-finite weights are refused.
    """
    weights = [1.0] * len(rankings) if weights is None else weights
    if len(weights) != len(rankings) or any(isinstance(w, bool) or not np.isfinite(w) or w < 0 for w in weights):
        raise ValueError("one finite weight of at least 0 is needed for each ranking")
    if isinstance(rank_constant, bool) or not np.isfinite(rank_constant) or rank_constant < 0:
        raise ValueError("rank_constant must be finite and not negative")
    used = [r.select("query_id", "doc_id", (F.lit(float(w)) / (F.lit(float(rank_constant)) + F.col("rank"))).alias("part")) for r, w in zip(rankings, weights) if w]
    if not used:
        used = [rankings[0].select("query_id", "doc_id", F.lit(0.0).alias("part")).limit(0)]
    fused = reduce(DataFrame.unionByName, used).groupBy("query_id", "doc_id").agg(F.sum("part").alias("score"))
    return rank_in_query(fused, k)


def mmr(candidates: DataFrame, k: int = 5, balance: float = 0.5) -> DataFrame:
    """(query_id, doc_id, score, rank): greedy picks by balance * relevance - (1 - balance) * largest similarity to a pick.

    ``candidates`` has query_id, doc_id, score (relevance) and embedding; pools are bounded by the
    retrieval depth that made them, so a query is one small group. The score stays the relevance.
    """
    check_k(k)
    if isinstance(balance, bool) or not 0 <= balance <= 1:
        raise ValueError("balance must be from 0 to 1")

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id"]).reset_index(drop=True)
        x = np.array(pdf["embedding"].tolist(), dtype=np.float64)
        if not np.isfinite(x).all() or not np.abs(x).max(axis=1).all():
            raise ValueError("embeddings must be finite and not zero")
        x = x / np.abs(x).max(axis=1, keepdims=True)
        x = x / np.linalg.norm(x, axis=1, keepdims=True)
        rel, left, chosen = pdf["score"].to_numpy(float), list(range(len(pdf))), []
        near = np.full(len(pdf), -np.inf)
        while left and len(chosen) < k:
            gain = rel if not chosen else balance * rel - (1 - balance) * near
            best = max(left, key=lambda i: (round(gain[i], 12), -i))
            chosen.append(best)
            left.remove(best)
            near = np.maximum(near, x @ x[best])
        out = pdf.iloc[chosen][["query_id", "doc_id", "score"]]
        return out.assign(rank=range(1, len(out) + 1))

    kinds = dict(candidates.dtypes)
    return candidates.select("query_id", "doc_id", "score", "embedding").groupBy("query_id").applyInPandas(pick, f"query_id {kinds['query_id']}, doc_id {kinds['doc_id']}, score double, rank int")


def retrieve_batch(queries: DataFrame, ranking: DataFrame) -> DataFrame:
    """(query_id, ranked): every query with its ranking as an array; queries without hits have an empty one."""
    lists = ranking.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "doc_id", "score"))).alias("ranked"))
    empty = F.array().cast(lists.schema["ranked"].dataType)
    return queries.select("query_id").join(lists, "query_id", "left").select("query_id", F.coalesce("ranked", empty).alias("ranked"))


def assert_batch(queries: DataFrame, ranking: DataFrame, k: int) -> None:
    """ValueError unless query ids are unique, and every ranking belongs to one of them, has at most k ids and none twice."""
    twice = queries.groupBy("query_id").count().filter("count > 1").select(F.lit("repeated query id").alias("rule"), F.col("query_id").cast("string").alias("key"))
    stray = ranking.join(queries, "query_id", "left_anti").select(F.lit("unknown query id").alias("rule"), F.col("query_id").cast("string").alias("key"))
    sizes = ranking.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("doc_id").alias("ids"))
    off = sizes.filter((F.col("n") > k) | (F.col("ids") < F.col("n"))).select(F.lit("too many or repeated ids").alias("rule"), F.col("query_id").cast("string").alias("key"))
    if found := twice.unionByName(stray).unionByName(off).limit(5).collect():
        raise ValueError("; ".join(f"{r['rule']}: {r['key']}" for r in found))


def valid_ranked(ranking: DataFrame, corpus: DataFrame, k: int = 5) -> DataFrame:
    """(rule, query_id, detail): violations of a long-form ranking; sortedness is not required."""
    unknown = ranking.join(corpus.select("doc_id"), "doc_id", "left_anti").select(F.lit("unknown id").alias("rule"), "query_id", F.col("doc_id").alias("detail"))
    twice = ranking.groupBy("query_id", "doc_id").count().filter("count > 1").select(F.lit("repeated id").alias("rule"), "query_id", F.col("doc_id").alias("detail"))
    long = ranking.groupBy("query_id").count().filter(F.col("count") > k).select(F.lit("too long").alias("rule"), "query_id", F.col("count").cast("string").alias("detail"))
    odd = ranking.filter(F.col("score").isNull() | F.isnan("score") | (F.abs("score") == float("inf"))).select(F.lit("score not finite").alias("rule"), "query_id", F.col("doc_id").alias("detail"))
    return unknown.unionByName(twice).unionByName(long).unionByName(odd)
