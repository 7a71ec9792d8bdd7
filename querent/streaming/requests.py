"""Prediction requests as a stream against a static index; an addition to the batch engine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from querent.functions.text import valid_identifier, valid_request
from querent.operators import bm25
from querent.sources.jsonl import REQUESTS


def answer_stream(spark: SparkSession, source: str, output: str, checkpoint: str, corpus: DataFrame, k: int = 5) -> StreamingQuery:
    """Reads request files as they come and writes their rankings; each micro-batch is one search of an index that is built once.

    Invalid requests are written with an empty ranking. A batch that is run again replaces its own output.
    """
    index = bm25.build_index(corpus)
    requests = spark.readStream.schema(REQUESTS).json(source)

    def search(batch: DataFrame, number: int) -> None:
        good = batch.filter(valid_identifier(F.col("query_id")) & valid_request(F.col("question"))).dropDuplicates(["query_id"])
        ranked = bm25.search_index(good, index, k).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "doc_id", "score"))).alias("ranked"))
        out = batch.select("query_id").distinct().join(ranked, "query_id", "left")
        out.write.mode("overwrite").parquet(f"{output}/batch={number}")

    return requests.writeStream.foreachBatch(search).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
