"""Retrieval metrics of rankings against relevant ids, as aggregates over per-query values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from querent.functions.text import discount, has_answer

CUTOFFS = (1, 3, 5)


def invalid_rankings(rows: DataFrame, ranked: str = "ranked_ids", relevant: str = "relevant_ids", key: str = "query_id") -> DataFrame:
    """(key, rule): rows whose ranking or relevant ids are missing, repeat an id, or have a blank one; grades are held by ``invalid_grades``."""
    def broken(c: str) -> Column:
        ids = F.col(c)
        return F.when(ids.isNull(), f"{c} missing").when(F.size(F.array_distinct(ids)) < F.size(ids), f"{c} repeated").when(~F.forall(ids, has_answer), f"{c} blank")

    rules = rows.select(key, F.explode(F.array_compact(F.array(broken(ranked), broken(relevant)))).alias("rule"))
    return rules.withColumnRenamed(key, "key")


def invalid_grades(grades: DataFrame) -> DataFrame:
    """(query_id, doc_id): grades that aren't finite numbers from 0 to 32."""
    ok = F.col("grade").isNotNull() & ~F.isnan(F.col("grade").cast("double")) & F.col("grade").between(0, 32)
    return grades.filter(~ok).select("query_id", "doc_id")


def hits_at(ranked: Column, relevant: Column, k: int) -> Column:
    return F.size(F.array_intersect(F.slice(ranked, 1, k), relevant))


def recall(ranked: Column, relevant: Column, k: int) -> Column:
    """Share of the relevant ids among the first k; null without relevant ids."""
    return F.when(F.size(relevant) > 0, hits_at(ranked, relevant, k) / F.size(relevant))


def precision(ranked: Column, relevant: Column, k: int) -> Column:
    """Relevant ids among the first k by k, also when fewer came back; null without relevant ids."""
    return F.when(F.size(relevant) > 0, hits_at(ranked, relevant, k) / F.lit(k))


def first_hit(ranked: Column, relevant: Column, k: int | None = None) -> Column:
    within = ranked if k is None else F.slice(ranked, 1, k)
    return F.array_min(F.transform(F.array_intersect(within, relevant), lambda d: F.array_position(within, d)))


def reciprocal_rank(ranked: Column, relevant: Column, k: int | None = None) -> Column:
    """1 / rank of the first relevant id, 0 when missed; null without relevant ids."""
    return F.when(F.size(relevant) > 0, F.coalesce(1.0 / first_hit(ranked, relevant, k), F.lit(0.0)))


def average_precision(ranked: Column, relevant: Column, k: int) -> Column:
    """Sum of the precisions at hits by the number of all relevant ids; null without relevant ids."""
    top = F.slice(ranked, 1, k)
    state = F.aggregate(
        top,
        F.struct(F.lit(0).alias("i"), F.lit(0).alias("hits"), F.lit(0.0).alias("sum")),
        lambda a, d: F.struct(
            (a["i"] + 1).alias("i"), (a["hits"] + F.array_contains(relevant, d).cast("int")).alias("hits"),
            (a["sum"] + F.when(F.array_contains(relevant, d), (a["hits"] + 1) / (a["i"] + 1)).otherwise(0.0)).alias("sum"),
        ),
        lambda a: a["sum"],
    )
    return F.when(F.size(relevant) > 0, state / F.size(relevant))


def ndcg(ranking: DataFrame, grades: DataFrame, k: int) -> DataFrame:
    """(query_id, ndcg): graded gain of the first k by the best that all judged documents allow; null if that is 0."""
    order = Window.partitionBy("query_id").orderBy(F.desc("grade"), "doc_id")
    ideal = grades.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= k).groupBy("query_id").agg(F.sum(discount(F.col("grade"), F.col("r"))).alias("ideal"))
    got = ranking.filter(F.col("rank") <= k).join(grades, ["query_id", "doc_id"]).groupBy("query_id").agg(F.sum(discount(F.col("grade"), F.col("rank"))).alias("dcg"))
    joined = ideal.join(got, "query_id", "left")
    return joined.select("query_id", F.when(F.col("ideal") > 0, F.coalesce("dcg", F.lit(0.0)) / F.col("ideal")).alias("ndcg"))


def retrieval_aggregates(ranked: str = "ranked_ids", relevant: str = "relevant_ids", cutoffs: tuple[int, ...] = CUTOFFS) -> list[Column]:
    """Mean recall and precision at the cutoffs and mean reciprocal rank within the largest, over answerable rows."""
    r, g = F.col(ranked), F.col(relevant)
    out = [F.avg(recall(r, g, k)).alias(f"recall_at_{k}") for k in cutoffs]
    out += [F.avg(precision(r, g, k)).alias(f"precision_at_{k}") for k in cutoffs]
    return [*out, F.avg(reciprocal_rank(r, g, max(cutoffs))).alias(f"mrr_at_{max(cutoffs)}")]


def hit_rate(reciprocal: str = "rr") -> list[Column]:
    """Share of defined reciprocal ranks that are positive, and their number."""
    return [F.avg(F.when(F.col(reciprocal) > 0, 1.0).when(F.col(reciprocal).isNotNull(), 0.0)).alias("hit_rate"), F.count(reciprocal).alias("samples")]
