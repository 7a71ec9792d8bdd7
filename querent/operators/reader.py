"""Reading answers from retrieved documents: a pluggable reader, selection, prediction."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from querent.functions.text import answer_em, answer_f1, has_answer, valid_span

TRACE = "answer string, confidence double, start int, end int"


class Reader(Protocol):
    """Finds one span of a text for a question: (answer, score in [0, 1], start, end)."""

    fingerprint: str

    def read(self, question: str, text: str) -> tuple[str, float, int, int]: ...


class LexicalReader:
    """A stand-in for a trained reader: the sentence that shares most words with the question."""

    fingerprint = "lexical-1"

    def read(self, question: str, text: str) -> tuple[str, float, int, int]:
        asked = set(re.findall(r"\w+", question.lower()))
        best = ("", 0.0, 0, 0)
        for m in re.finditer(r"[^.!?\n]+[.!?]?", text):
            own = m.group().strip()
            words = set(re.findall(r"\w+", own.lower()))
            score = len(asked & words) / max(1, len(asked))
            if own and score > best[1]:
                start = m.start() + len(m.group()) - len(m.group().lstrip())
                best = (own, score, start, start + len(own))
        return best


def reader_trace(candidates: DataFrame, reader: Reader, continue_on_error: bool = False) -> DataFrame:
    """Adds answer, confidence, start, end to rows (query_id, question, document_id, rank, text).

    With ``continue_on_error`` also ``error``: what the reader raised on a row, which then has a blank
    answer; without, the first error ends the job.
    """

    def read(question: str, text: str) -> tuple:
        try:
            return (*reader.read(question, text), None)
        except Exception as e:  # noqa: BLE001 - whatever a reader raises belongs to its row
            if not continue_on_error:
                raise
            return "", 0.0, None, None, f"{type(e).__name__}: {e}"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            spans = [read(q, t) for q, t in zip(pdf["question"], pdf["text"])]
            got = pd.DataFrame(spans, columns=["answer", "confidence", "start", "end", "error"], index=pdf.index)
            got = got.astype({"start": "Int32", "end": "Int32"})
            yield pd.concat([pdf[["query_id", "document_id", "rank", "text"]], got if continue_on_error else got.drop(columns="error")], axis=1)

    kinds = dict(candidates.dtypes)
    src = candidates.filter("question is not null and text is not null").select("query_id", "question", "document_id", "rank", "text")
    return src.mapInPandas(run, f"query_id {kinds['query_id']}, document_id {kinds['document_id']}, rank int, text string, {TRACE}" + (", error string" if continue_on_error else ""))


def invalid_results(trace: DataFrame) -> DataFrame:
    """Rows whose score isn't in [0, 1] or whose span isn't the answer; a blank answer has no span."""
    ok = F.col("confidence").between(0, 1) & ~F.isnan("confidence")
    return trace.filter(~(F.coalesce(ok, F.lit(False)) & (~has_answer(F.col("answer")) | valid_span(F.col("text"), F.col("answer"), F.col("start"), F.col("end")))))


def select_answer(candidates: DataFrame, queries: DataFrame | None = None, strategy: str = "max_score") -> DataFrame:
    """(query_id, raw_answer, confidence, document_id, start, end): one candidate a query.

    ``max_score``: the largest confidence, then the smallest id; ``top_ranked``: the best rank, then the
    largest confidence. Queries without candidates get a blank answer of confidence 0.
    """
    if strategy not in ("max_score", "top_ranked"):
        raise ValueError("strategy must be max_score or top_ranked")
    order = F.struct(-F.col("confidence"), F.col("document_id")) if strategy == "max_score" else F.struct(F.col("rank"), -F.col("confidence"), F.col("document_id"))
    best = candidates.groupBy("query_id").agg(F.min_by(F.struct("answer", "confidence", "document_id", "start", "end"), order).alias("x"))
    best = best.select("query_id", F.col("x.answer").alias("raw_answer"), "x.confidence", "x.document_id", "x.start", "x.end")
    if queries is None:
        return best
    return queries.select("query_id").join(best, "query_id", "left").fillna({"raw_answer": "", "confidence": 0.0})


def oracle_reader(queries: DataFrame, corpus: DataFrame, reader: Reader) -> DataFrame:
    """(query_id, oracle_answer, oracle_em, oracle_f1): the reader on the relevant documents only, the best it could do."""
    gold = queries.select("query_id", "question", F.posexplode("relevant_ids").alias("rank", "document_id"))
    texts = gold.join(corpus.select(F.col("doc_id").alias("document_id"), "text"), "document_id")
    picked = select_answer(reader_trace(texts, reader), queries)
    scored = picked.join(queries.select("query_id", "answers"), "query_id")
    return scored.select("query_id", F.col("raw_answer").alias("oracle_answer"), answer_em(F.col("raw_answer"), F.col("answers")).alias("oracle_em"), answer_f1(F.col("raw_answer"), F.col("answers")).alias("oracle_f1"))


def predict(queries: DataFrame, ranking: DataFrame, corpus: DataFrame, reader: Reader, threshold: float, reader_k: int = 3, strategy: str = "max_score", continue_on_error: bool = False) -> DataFrame:
    """(query_id, answer, confidence, abstained, document_id, start, end, retrieved_ids): nulls where it abstains.

    With ``continue_on_error`` also ``error``, the first that the reader raised on a document of the question.
    """
    top = ranking.filter(F.col("rank") <= reader_k).select("query_id", F.col("doc_id").alias("document_id"), "rank")
    rows = top.join(queries.select("query_id", "question"), "query_id").join(corpus.select(F.col("doc_id").alias("document_id"), "text"), "document_id")
    trace = reader_trace(rows, reader, continue_on_error)
    picked = select_answer(trace, queries, strategy)
    if continue_on_error:
        # the trace is read twice; the reader must give the same again, as after the loss of an executor
        picked = picked.join(trace.groupBy("query_id").agg(F.min_by("error", F.when(F.col("error").isNotNull(), F.col("rank"))).alias("error")), "query_id", "left")
    listed = ranking.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "doc_id"))), lambda x: x["doc_id"]).alias("ids"))
    joined = picked.join(listed, "query_id", "left")
    ok = has_answer(F.col("raw_answer")) & (F.col("confidence") >= threshold)
    only = lambda c: F.when(ok, F.col(c)).alias(c)
    # the served string has a blank after each comma
    written = lambda d: F.regexp_extract(F.to_json(F.array(d)), r"(?s)^\[(.*)\]$", 1)
    ids = F.concat(F.lit("["), F.concat_ws(", ", F.transform(F.coalesce("ids", F.array()), lambda d: written(d.cast("string")))), F.lit("]"))
    return joined.select("query_id", F.when(ok, F.col("raw_answer")).otherwise("").alias("answer"), "confidence", (~ok).alias("abstained"), only("document_id"), only("start"), only("end"), ids.alias("retrieved_ids"), *(["error"] if continue_on_error else []))


def top_of_trace(trace: DataFrame) -> DataFrame:
    """Marks the selected candidate of each query; all keep their retrieval rank."""
    order = Window.partitionBy("query_id").orderBy(F.desc("confidence"), "document_id")
    return trace.withColumn("selected", F.row_number().over(order) == 1)


#: The served shape of a prediction; what an abstention leaves out is null.
PREDICTION = T.StructType([
    T.StructField("query_id", T.StringType(), False), T.StructField("answer", T.StringType(), False), T.StructField("confidence", T.DoubleType(), False),
    T.StructField("abstained", T.BooleanType(), False), T.StructField("document_id", T.StringType()), T.StructField("start", T.IntegerType()),
    T.StructField("end", T.IntegerType()), T.StructField("retrieved_ids", T.StringType(), False),
])


def prediction_frame(predictions: DataFrame) -> DataFrame:
    """Predictions in the served shape: its columns in order, with its types."""
    return predictions.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in PREDICTION.fields])


def predict_questions(spark: SparkSession, asked: pd.DataFrame, answer: Callable[[DataFrame], DataFrame]) -> pd.DataFrame:
    """Predictions for a small pandas frame with the one column ``question``, under its index.

    ``answer`` takes (query_id, question) and gives predictions; the frame's rows are told apart by
    their position, so that repeated questions and index values keep their rows.
    """
    if list(asked.columns) != ["question"]:
        raise ValueError("the frame must have the one column question")
    rows = spark.createDataFrame([(str(i), q) for i, q in enumerate(asked["question"])], "query_id string, question string")
    got = prediction_frame(answer(rows)).toPandas().set_index("query_id").reindex([str(i) for i in range(len(asked))])
    return got.set_index(asked.index)
