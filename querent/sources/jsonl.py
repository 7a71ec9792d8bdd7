"""Strict JSON Lines: objects only, exact fields, no duplicate keys, no NaN or infinities."""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from querent.functions.text import QUESTION_LIMIT, TEXT_LIMIT, is_blank
from querent.operators import audit
from querent.sources.contracts import number

MAX_BYTES, MAX_RECORDS, MAX_REQUESTS = 16 * 1024 * 1024, 100_000, 10_000
CORPUS = T.StructType([T.StructField(c, T.StringType()) for c in ("doc_id", "title", "text")])
QUERIES = T.StructType([T.StructField("query_id", T.StringType()), T.StructField("question", T.StringType()), T.StructField("relevant_ids", T.ArrayType(T.StringType())), T.StructField("answers", T.ArrayType(T.StringType()))])
REQUESTS = T.StructType([T.StructField(c, T.StringType()) for c in ("query_id", "question")])


class _Strict(json.JSONDecoder):
    """Objects with distinct keys, numbers that JSON has."""

    def __init__(self) -> None:
        super().__init__(object_pairs_hook=self._object, parse_constant=self._name)

    @staticmethod
    def _object(pairs: list[tuple[str, object]]) -> dict:
        fields = dict(pairs)
        if len(fields) < len(pairs):
            often = Counter(name for name, _ in pairs)
            raise ValueError("duplicate JSON field " + ", ".join(sorted(name for name, n in often.items() if n > 1)))
        return fields

    @staticmethod
    def _name(name: str) -> None:
        raise ValueError(f"{name} is a nonstandard number")


def strict_loads(text: str) -> object:
    return _Strict().decode(text)


def _fits(value: object, kind: T.DataType) -> bool:
    if isinstance(kind, T.ArrayType):
        return isinstance(value, list) and all(_fits(v, kind.elementType) for v in value)
    return isinstance(value, str) if isinstance(kind, T.StringType) else value is None or isinstance(value, (int, float))


def scan_jsonl(spark: SparkSession, path: str, schema: T.StructType, max_bytes: int = MAX_BYTES, max_records: int = MAX_RECORDS) -> DataFrame:
    """Rows of one file, with ``line`` (1-based, blank lines counted) and ``problem`` (null if the line is good).

    Lines are parsed on the workers; the byte and record budgets are checked by one aggregate first.
    """
    if not all(number(1, float("inf"), whole=True)(limit) for limit in (max_bytes, max_records)):
        raise ValueError("a budget is a whole number from 1 on")
    names = [f.name for f in schema.fields]
    # whole lines, in order: the row index of a text scan is the line number less one
    lines = spark.read.option("lineSep", "\n").text(path).select("value", F.col("_metadata.file_path").alias("file"))
    lines = lines.withColumn("_i", F.monotonically_increasing_id())
    lines = lines.withColumn("line", _line_numbers(lines))
    size = lines.agg(F.sum(F.octet_length("value") + 1).alias("bytes"), F.count_if(~is_blank(F.col("value"))).alias("records")).first()
    for what, most, got in (("bytes", max_bytes, (size["bytes"] or 1) - 1), ("records", max_records, size["records"])):
        if got > most:
            raise ValueError(f"{path}: {got} {what}, the budget is {most}")
    if not size["records"]:
        raise ValueError(f"{path}: at least one object is needed")

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for line, value in zip(pdf["line"], pdf["value"]):
                item, problem = None, None
                try:
                    item = strict_loads(value)
                    if not isinstance(item, dict):
                        problem = "records must be objects"
                    elif set(item) != set(names):
                        problem = "fields must be " + ", ".join(names)
                    elif bad := [f.name for f in schema.fields if not _fits(item[f.name], f.dataType)]:
                        problem = "wrong type: " + ", ".join(bad)
                except ValueError as e:
                    problem = f"malformed JSONL: {e}"
                rows.append([line, problem, *(None if problem else item[n] for n in names)])
            yield pd.DataFrame(rows, columns=["line", "problem", *names])

    out = T.StructType([T.StructField("line", T.LongType()), T.StructField("problem", T.StringType()), *schema.fields])
    return lines.filter(~is_blank(F.col("value"))).select("line", "value").mapInPandas(parse, out)


def _line_numbers(lines: DataFrame):
    """Line numbers from partition-wise indices: each partition's first number is a sum over those before, of which there are few."""
    counts = {r["p"]: r["n"] for r in lines.groupBy(F.shiftright("_i", 33).alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()}
    upto, starts = 0, []
    for p in sorted(counts):
        starts.append((p, upto))
        upto += counts[p]
    first = F.create_map(*[F.lit(x) for pair in starts for x in pair]) if starts else F.lit(None)
    within = F.col("_i").bitwiseAND((1 << 33) - 1)
    return (F.element_at(first, F.shiftright("_i", 33)) if starts else F.lit(0)) + within + 1


def raise_first_problem(rows: DataFrame, path: str) -> DataFrame:
    """The rows without ``line`` and ``problem``; ValueError with path and line if a line is bad."""
    bad = rows.filter("problem is not null").orderBy("line").limit(1).collect()
    if bad:
        raise ValueError(f"{path}:{bad[0]['line']}: {bad[0]['problem']}")
    return rows.drop("problem")


def scan_corpus(spark: SparkSession, path: str) -> DataFrame:
    """Documents of a file; ValueError names the first violation."""
    docs = raise_first_problem(scan_jsonl(spark, path, CORPUS), path).withColumnRenamed("line", "_ord")
    audit.assert_valid(audit.audit_corpus(docs))
    return docs


def scan_queries(spark: SparkSession, path: str, corpus: DataFrame) -> DataFrame:
    """Labelled questions of a file, held against the corpus; ValueError names the first violation."""
    rows = raise_first_problem(scan_jsonl(spark, path, QUERIES), path).withColumnRenamed("line", "_ord")
    element = F.forall("relevant_ids", lambda x: ~is_blank(x) & (F.length(x) <= TEXT_LIMIT)) & F.forall("answers", lambda x: ~is_blank(x) & (F.length(x) <= TEXT_LIMIT))
    twice = (F.size(F.array_distinct("relevant_ids")) < F.size("relevant_ids")) | (F.size(F.array_distinct("answers")) < F.size("answers"))
    lists = rows.filter(~element | twice).select(F.lit("repeated or blank list element").alias("rule"), F.col("query_id").alias("key"), F.lit(None).cast("string").alias("detail"))
    audit.assert_valid(lists.unionByName(audit.audit_queries(rows.withColumn("split", F.lit("file")), corpus)))
    return rows


def scan_requests(spark: SparkSession, path: str) -> DataFrame:
    """1 to 10,000 prediction requests with distinct ids."""
    rows = raise_first_problem(scan_jsonl(spark, path, REQUESTS, max_records=MAX_REQUESTS), path).withColumnRenamed("line", "_ord")
    validate_requests(rows)
    return rows


def validate_requests(rows: DataFrame) -> None:
    audit.assert_valid(audit.bad_identifiers(rows, "query_id").unionByName(audit.bad_texts(rows, "query_id", "question", QUESTION_LIMIT)).unionByName(audit.duplicates(rows, "query_id")))


def sink_predictions(results: DataFrame, path: str, order: str = "_ord") -> dict[str, int]:
    """Writes results in input order as JSON lines, never over existing files; returns counts of successes and errors.

    A row with a non-null ``error`` becomes {query_id, error}. The files appear all or not at all.
    """
    body = [c for c in results.columns if c not in (order, "error")]
    line = F.when(F.col("error").isNotNull(), F.to_json(F.struct("query_id", "error"))).otherwise(F.to_json(F.struct(*body), {"ignoreNullFields": "false"}))
    ordered = results.select(order, F.col("error").isNull().alias("ok"), line.alias("value")).orderBy(order)
    seen = Observation("predictions")
    counted = ordered.observe(seen, F.count_if("ok").alias("ok"), F.count_if(~F.col("ok")).alias("bad"))
    counted.select("value").write.mode("errorifexists").text(path)
    return {"succeeded": seen.get["ok"], "failed": seen.get["bad"]}
