"""The relations that the operators work on, from the supplied tables; each has the same view in SQL.

Repeated ingestions count once; document ids compare trimmed and in lower case; a question id's first
row stands for it; an evaluation row is a distinct attempt that passes validation, with the gold data of its question.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from querent.functions.text import finite, has_answer


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def tidy(c):
    return F.lower(F.trim(c))


def corpus(spark: SparkSession, sf: str) -> DataFrame:
    """doc_id, title, text, source; one row a document."""
    rows = read(spark, sf, "corpus").select(tidy(F.col("doc_id")).alias("doc_id"), "title", "text", "source")
    return rows.filter("doc_id is not null").dropDuplicates(["doc_id"])


def questions(spark: SparkSession, sf: str) -> DataFrame:
    """query_id, question, relevant_ids, answers, split, source; one row an id."""
    rows = read(spark, sf, "queries").filter("query_id is not null")
    first = rows.groupBy("query_id").agg(F.min(F.struct("created_at", "split", "question", "relevant_ids", "answers", "source")).alias("x"))
    relevant = F.array_sort(F.array_distinct(F.transform(F.filter("x.relevant_ids", lambda d: d.isNotNull()), tidy)))
    answers = F.array_sort(F.array_distinct(F.filter("x.answers", has_answer)))
    return first.select("query_id", "x.question", relevant.alias("relevant_ids"), answers.alias("answers"), "x.split", "x.source")


def attempts(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct attempts, before validation."""
    cols = ["experiment", "run_day", "query_id", "raw_answer", "confidence", "ranked_ids", "retrieval_ms", "reader_ms", "total_ms"]
    rows = read(spark, sf, "runner").filter("attempt_id is not null")
    return rows.groupBy("attempt_id").agg(F.min(F.struct("logged_at", *cols)).alias("x")).select("attempt_id", *[f"x.{c}" for c in cols])


def is_valid_row():
    """What an evaluation row must satisfy."""
    ids = F.col("ranked_ids")
    arrays = ids.isNotNull() & (F.size(F.array_distinct(ids)) == F.size(ids)) & F.forall(ids, has_answer)
    times = [finite(F.col(c)) & (F.col(c) >= 0) for c in ("retrieval_ms", "reader_ms", "total_ms")]
    return finite(F.col("confidence")) & F.col("confidence").between(0, 1) & arrays & times[0] & times[1] & times[2]


def evaluation_rows(spark: SparkSession, sf: str) -> DataFrame:
    gold = questions(spark, sf).select("query_id", "answers", "relevant_ids", "split")
    return attempts(spark, sf).filter(is_valid_row()).join(gold, "query_id")


#: The same relations in SQL, as common table expressions.
SQL_CORPUS = "c AS (SELECT DISTINCT lower(trim(doc_id)) AS doc_id, title, text, source FROM corpus WHERE doc_id IS NOT NULL)"
SQL_QUESTIONS = r"""q AS (
    SELECT query_id, question, split, source,
           list_sort(list_distinct(list_transform(list_filter(relevant_ids, lambda d: d IS NOT NULL), lambda d: lower(trim(d))))) AS relevant_ids,
           list_sort(list_distinct(list_filter(answers, lambda a: a IS NOT NULL AND regexp_matches(a, '\S')))) AS answers
    FROM queries WHERE query_id IS NOT NULL
    QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY created_at, split, question) = 1)"""
SQL_ATTEMPTS = """t AS (
    SELECT attempt_id, experiment, run_day, query_id, raw_answer, confidence, ranked_ids, retrieval_ms, reader_ms, total_ms
    FROM runner WHERE attempt_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY attempt_id ORDER BY logged_at) = 1)"""
_FINITE = "{0} IS NOT NULL AND NOT isnan({0}) AND NOT isinf({0}) AND {0} >= 0"
SQL_VALID = (
    _FINITE.format("confidence") + " AND confidence <= 1 AND ranked_ids IS NOT NULL AND len(list_distinct(ranked_ids)) = len(ranked_ids)"
    + r" AND len(list_filter(ranked_ids, lambda d: d IS NULL OR NOT regexp_matches(d, '\S'))) = 0"
    + "".join(" AND " + _FINITE.format(c) for c in ("retrieval_ms", "reader_ms", "total_ms"))
)
SQL_ROWS = f"{SQL_QUESTIONS}, {SQL_ATTEMPTS}, e AS (SELECT t.*, q.answers, q.relevant_ids, q.split FROM t JOIN q USING (query_id) WHERE {SQL_VALID})"
