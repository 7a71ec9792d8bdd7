"""Chunks of documents, and chunk hits rolled up to their parents."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from querent.functions.text import canonical_hash, check_k
from querent.operators.rank import rank_in_query

MAX_CHARS, OVERLAP = 512, 64


def chunk(corpus: DataFrame, max_chars: int = MAX_CHARS, overlap: int = OVERLAP) -> DataFrame:
    """(parent_id, ordinal, title, text, start, end): sliding windows; the last one ends with the text."""
    if isinstance(max_chars, bool) or isinstance(overlap, bool) or max_chars < 1 or not 0 <= overlap < max_chars:
        raise ValueError("overlap must be at least 0 and below max_chars")
    step = max_chars - overlap
    size = F.length("text")
    last = F.when(size <= max_chars, 0).otherwise(F.ceil((size - max_chars) / step)).cast("int")
    each = corpus.filter("text is not null").select(F.col("doc_id").alias("parent_id"), "title", "text", F.explode(F.sequence(F.lit(0), last)).alias("ordinal"))
    start = F.col("ordinal") * step
    return each.select("parent_id", "ordinal", "title", F.substring("text", start + 1, F.lit(max_chars)).alias("text"), start.alias("start"), F.least(start + max_chars, F.length("text")).alias("end"))


def with_chunk_ids(chunks: DataFrame, corpus: DataFrame) -> DataFrame:
    """Adds ``chunk_id``: a digest of the whole document, and the start."""

    @F.pandas_udf("string")
    def digest(ids: pd.Series, texts: pd.Series) -> pd.Series:
        return pd.Series([canonical_hash({"doc_id": i, "text": t})[:24] for i, t in zip(ids, texts)])

    keys = corpus.select(F.col("doc_id").alias("parent_id"), digest("doc_id", "text").alias("_d"))
    return chunks.join(keys, "parent_id").withColumn("chunk_id", F.concat(F.lit("chunk-"), "_d", F.lit("-"), F.col("start").cast("string"))).drop("_d")


def aggregate_chunks(hits: DataFrame, chunks: DataFrame, policy: str = "max", k: int = 5) -> DataFrame:
    """(query_id, doc_id, score, rank, best_chunk, start, end, chunk_ids): hits (query_id, chunk_id, score, rank) by parent.

    The best chunk has the largest score, then the smallest id; ``chunk_ids`` are in order of rank.
    """
    if policy not in ("max", "sum"):
        raise ValueError("policy must be max or sum")
    check_k(k)
    joined = hits.join(chunks.select("chunk_id", "parent_id", "start", "end"), "chunk_id")
    score = F.max("score") if policy == "max" else F.sum("score")
    best = F.min_by(F.struct("chunk_id", "start", "end"), F.struct(-F.col("score"), F.col("chunk_id")))
    by_parent = joined.groupBy("query_id", F.col("parent_id").alias("doc_id")).agg(score.alias("score"), best.alias("best"), F.transform(F.array_sort(F.collect_list(F.struct("rank", "chunk_id"))), lambda x: x["chunk_id"]).alias("chunk_ids"))
    ranked = rank_in_query(by_parent, k)
    return ranked.select("query_id", "doc_id", "score", "rank", F.col("best.chunk_id").alias("best_chunk"), F.col("best.start").alias("start"), F.col("best.end").alias("end"), "chunk_ids")


