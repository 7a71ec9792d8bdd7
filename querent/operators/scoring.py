"""Scoring of evaluation rows: abstention, answer scores, failure classes, and their aggregates.

``scored`` computes the per-row columns once; every metric is then one aggregate over them, global or
per group, so a report of all metrics is a single shuffle of one row a group and partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from querent.functions.text import answer_em, answer_f1, composed, has_answer
from querent.operators.metrics import CUTOFFS, hits_at, retrieval_aggregates

# The failure classes, in order of attribution.
FAILURES = ("correct_abstention", "unanswerable_false_positive", "retrieval_miss", "false_abstention", "correct", "reader_failure")
READER_K = 3

#: Groups up to this number have their largest weights broadcast.
SMALL_GROUPS = 100_000


def accepted(answer: Column, confidence: Column, threshold: Column) -> Column:
    """A nonblank answer whose confidence reaches the threshold; without a threshold every nonblank one."""
    return has_answer(answer) & F.coalesce(confidence >= threshold, threshold.isNull(), F.lit(False))


def failure_class(answer: Column, em: Column, relevant: Column, ranked: Column, reader_k: int = READER_K) -> Column:
    blank = ~has_answer(answer)
    return (
        F.when((F.size(relevant) == 0) & blank, FAILURES[0]).when(F.size(relevant) == 0, FAILURES[1])
        .when(hits_at(ranked, relevant, reader_k) == 0, FAILURES[2]).when(blank, FAILURES[3]).when(em == 1, FAILURES[4]).otherwise(FAILURES[5])
    )


def scored(rows: DataFrame, threshold: Column | float | None = None, reader_k: int = READER_K) -> DataFrame:
    """Adds answer (blank when abstaining), abstained, answer_em, answer_f1, failure."""
    limit = threshold if isinstance(threshold, Column) else F.lit(threshold).cast("double")
    ok = accepted(F.col("raw_answer"), F.col("confidence"), limit)
    out = rows.withColumn("abstained", ~ok).withColumn("answer", F.when(ok, F.col("raw_answer")).otherwise(""))
    out = out.withColumn("answer_em", answer_em(F.col("answer"), F.col("answers"))).withColumn("answer_f1", answer_f1(F.col("answer"), F.col("answers")))
    return out.withColumn("failure", failure_class(F.col("answer"), F.col("answer_em"), F.col("relevant_ids"), F.col("ranked_ids"), reader_k))


def metric_aggregates(cutoffs: tuple[int, ...] = CUTOFFS) -> list[Column]:
    """All metrics of scored rows; undefined rates are null."""
    gold = F.size("answers") > 0
    return [
        F.count(F.lit(1)).alias("query_count"),
        F.count_if(gold).alias("answerable_count"),
        F.count_if(~gold).alias("unanswerable_count"),
        F.count_if(F.size("relevant_ids") > 0).alias("retrieval_query_count"),
        F.count_if(~F.col("abstained")).alias("accepted_answer_count"),
        F.avg("answer_em").alias("answer_em"),
        F.avg("answer_f1").alias("answer_f1"),
        F.avg((~F.col("abstained")).cast("double")).alias("coverage"),
        F.avg(F.when(gold, F.col("answer_em"))).alias("answerable_em"),
        F.avg(F.when(gold, F.col("answer_f1"))).alias("answerable_f1"),
        F.avg(F.when(~gold, F.col("abstained").cast("double"))).alias("unanswerable_rejection_rate"),
        F.avg(F.when(~F.col("abstained"), F.col("answer_em"))).alias("selective_em"),
        *retrieval_aggregates(cutoffs=cutoffs),
        *failure_counts(),
    ]


def failure_counts(column: str = "failure") -> list[Column]:
    """Six counters; classes that don't occur count 0."""
    return [F.count_if(F.col(column) == name).alias(name) for name in FAILURES]


def latency_percentiles(columns: tuple[str, ...] = ("retrieval_ms", "reader_ms", "total_ms"), accuracy: int | None = None) -> list[Column]:
    """Medians and 95th percentiles: exact with linear interpolation, which holds the distinct values of a group in memory.

    With ``accuracy`` from a sketch of bounded size instead, whose rank is at most 1 / accuracy of the group's rows off.
    """
    at = (lambda c, share: F.percentile(c, F.lit(share))) if accuracy is None else (lambda c, share: F.approx_percentile(c, share, accuracy).cast("double"))
    return [at(c, share).alias(f"{c[:-3]}_p{round(share * 100)}_ms") for c in columns for share in (0.5, 0.95)]


def score_predictions(rows: DataFrame, threshold: Column | float | None = None, by: tuple[str, ...] = (), cutoffs: tuple[int, ...] = CUTOFFS, reader_k: int = READER_K) -> DataFrame:
    """One row of all metrics (a group)."""
    return scored(rows, threshold, reader_k).groupBy(*by).agg(*metric_aggregates(cutoffs), *latency_percentiles())


def slice_metrics(rows: DataFrame, labels: DataFrame, threshold: Column | float | None = None) -> DataFrame:
    """The metrics of each label of ``labels`` (query_id, labels); a row counts once for each of its labels.

    Labels are trimmed and compared in their composed form, a row's repeated ones count once; rows
    without one are left out. ``unknown_labelled`` finds annotations of ids that no row has.
    """
    each = labels.select("query_id", F.explode("labels").alias("label")).filter("label is not null")
    own = each.select("query_id", F.trim(composed("label")).alias("label")).filter("label <> ''").distinct()
    return scored(rows.join(own, "query_id"), threshold).groupBy("label").agg(*metric_aggregates()).orderBy("label")


def unknown_labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """(query_id): annotated ids that no row has."""
    return labels.select("query_id").distinct().join(rows.select("query_id"), "query_id", "left_anti")


def citation_metrics(by: tuple[str, ...], rows: DataFrame) -> DataFrame:
    """(citation_precision, supported_em): cited documents that are relevant among accepted answers; exact answers with a relevant citation among all rows."""
    supported = F.array_contains("relevant_ids", F.col("document_id"))
    ok = ~F.col("abstained") & F.col("document_id").isNotNull()
    return rows.groupBy(*by).agg(
        F.avg(F.when(~F.col("abstained"), F.coalesce(supported, F.lit(False)).cast("double"))).alias("citation_precision"),
        F.avg(F.when(ok & supported, F.col("answer_em")).otherwise(0.0)).alias("supported_em"),
    )


def weighted_mean(rows: DataFrame, value: str, weight: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Sum of value * weight by sum of weight; null if all weights are 0.

    Weights are divided by the largest of their group before anything is summed, so that they may be as
    large as numbers go. A negative, missing or infinite weight makes its group's mean NaN.
    """
    kept = rows.select(*by, F.col(value).alias("_v"), F.col(weight).cast("double").alias("_w"))
    bad = F.col("_w").isNull() | F.isnan("_w") | (F.col("_w") < 0) | (F.col("_w") == float("inf"))
    tops = kept.groupBy(*by).agg(F.max("_w").alias("_top"), F.coalesce(F.bool_or(bad), F.lit(False)).alias("_bad"))
    if by:
        joined = kept.join(F.broadcast(tops) if tops.count() <= SMALL_GROUPS else tops, list(by))
    else:
        joined = kept.withColumn("_top", tops.select("_top").scalar()).withColumn("_bad", tops.select("_bad").scalar())
    scaled = joined.withColumn("_w", F.try_divide("_w", "_top"))
    sums = scaled.groupBy(*by).agg(F.sum(F.col("_v") * F.col("_w")).alias("_vw"), F.sum("_w").alias("_sum"), F.max("_top").alias("_top"), F.max("_bad").alias("_bad"))
    return sums.select(*by, F.when(F.col("_bad"), float("nan")).when(F.col("_top") > 0, F.col("_vw") / F.col("_sum")).alias("weighted_mean"))


def collect_predictions(samples: DataFrame) -> DataFrame:
    """(query_id, repeats, stable, retrieval_ms, reader_ms, total_ms): medians over repeats; ``stable`` if nothing else differs."""
    answer = F.struct("raw_answer", "confidence", "ranked_ids")
    return samples.groupBy("query_id").agg(
        F.count(F.lit(1)).alias("repeats"), (F.min(F.xxhash64(answer)) == F.max(F.xxhash64(answer))).alias("stable"),
        *[F.percentile(c, F.lit(0.5)).alias(c) for c in ("retrieval_ms", "reader_ms", "total_ms")],
    )
