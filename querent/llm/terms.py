"""How distinctive a term is per record: probabilistic relevance weights over the whole collection."""

from __future__ import annotations

import re
import sys
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from querent.plans.skew import join_on_hot_key
from querent.plans.staging import Stage
from querent.plans.workers import once

K1, B = 1.2, 0.75
LATIN_RUN = "[a-zß-öø-ɏ]{4,}"


def format_characters() -> frozenset[str]:
    """The characters of category Cf of this Python's Unicode version."""
    return once(("format characters",), lambda: frozenset(chr(c) for c in range(sys.maxunicode + 1) if unicodedata.category(chr(c)) == "Cf"))


def folded(text: str) -> str:
    """NFKC, without format characters, in lower case."""
    if text.isascii():
        return text.lower()
    if not unicodedata.is_normalized("NFKC", text):
        text = unicodedata.normalize("NFKC", text)
    for c in format_characters().intersection(text):
        text = text.replace(c, "")
    return text.lower()


def _count_terms(pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = re.compile(pattern).findall
        for b in batches:
            ids, texts = b.column(0).to_pylist(), [c.to_pylist() for c in b.columns[1:]]
            rows_id, rows_term, rows_tf, rows_len = [], [], [], []
            for i, parts in zip(ids, zip(*texts)):
                counts: Counter = Counter()
                for part in parts:
                    if part:
                        counts.update(find(folded(part)))
                size = sum(counts.values())
                rows_id += [i] * max(1, len(counts))
                rows_term += list(counts) or [None]
                rows_tf += list(counts.values()) or [0]
                rows_len += [size] * max(1, len(counts))
            yield pa.RecordBatch.from_arrays([pa.array(rows_id, b.schema.field(0).type), pa.array(rows_term, pa.string()), pa.array(rows_tf, pa.int64()), pa.array(rows_len, pa.int64())], ["doc", "term", "tf", "len"])

    return run


def distinctive_terms(df: DataFrame, id_col: str = "doc_id", text_cols: tuple[str, ...] = ("title", "text"), pattern: str = LATIN_RUN, k1: float = K1, b: float = B) -> DataFrame:
    """(doc, term, tf, df, score) for each term of each record.

    score = ln(1 + (N - df + 0.5) / (df + 0.5)) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * len / mean len)),
    with document counts and the mean length over all records, those without a term included. Terms are
    matches of ``pattern`` in the folded text columns, which are separate strings. Repeated rows of an
    id count once; rows without id take no part; null texts count as empty.
    """
    stage = Stage(df.sparkSession, "terms")
    given = df.filter(F.col(id_col).isNotNull()).select(F.col(id_col).alias("doc"), *[F.col(c).cast("string").alias(f"t{i}") for i, c in enumerate(text_cols)])
    kind = df.schema[id_col].dataType.simpleString()
    counted = given.mapInArrow(_count_terms(pattern), f"doc {kind}, term string, tf bigint, len bigint")
    # repeats of an id hold the same terms, so the largest count is the count; combined map-side
    terms = stage.write(counted.groupBy("doc", "term").agg(F.max("tf").alias("tf"), F.max("len").alias("len")), "terms")
    size = terms.groupBy("doc").agg(F.max("len").alias("len")).agg(F.count(F.lit(1)).alias("n"), F.avg("len").alias("mean")).first()
    n, mean = size["n"], size["mean"] or 1.0
    terms = terms.filter("term is not null")
    seen = terms.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    scored = join_on_hot_key(terms, seen, "term", hot_at=max(1000, n // 1000), count_col="df")
    idf = F.log1p((F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.lit(mean)))
    return scored.select("doc", "term", "tf", "df", (idf * weight).alias("score"))
