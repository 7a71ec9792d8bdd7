"""Contracts as data: each rule is a frame of its violations (rule, key, detail)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from querent.functions.text import QUESTION_LIMIT, TEXT_LIMIT, ascii_key, finite, has_answer, question_key, valid_identifier, valid_text


def _violations(rule: str, df: DataFrame, key: str, detail: Column | None = None) -> DataFrame:
    text = F.lit(None).cast("string") if detail is None else detail.cast("string")
    return df.select(F.lit(rule).alias("rule"), F.col(key).cast("string").alias("key"), text.alias("detail"))


def bad_identifiers(df: DataFrame, key: str) -> DataFrame:
    return _violations("identifier", df.filter(~valid_identifier(F.col(key))), key)


def bad_texts(df: DataFrame, key: str, column: str, limit: int = TEXT_LIMIT) -> DataFrame:
    return _violations(f"text:{column}", df.filter(~valid_text(F.col(column), limit)), key, F.length(column))


def duplicates(df: DataFrame, key: str) -> DataFrame:
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return _violations("duplicate", counts, key, F.col("n"))


def duplicate_questions(queries: DataFrame, exact: bool = True) -> DataFrame:
    """(split, key, ids): questions that stand under several ids of one split; ``exact`` folds case as Python does."""
    key = question_key("question") if exact else ascii_key(F.col("question"))
    keyed = queries.filter("question is not null").select("split", "query_id", key.alias("key")).filter("key <> ''")
    return keyed.groupBy("split", "key").agg(F.count_distinct("query_id").alias("ids")).filter("ids > 1")


def unknown_gold(queries: DataFrame, corpus: DataFrame) -> DataFrame:
    """(query_id, doc_id): relevant ids that no document has."""
    return queries.select("query_id", F.explode("relevant_ids").alias("doc_id")).distinct().join(corpus.select("doc_id"), "doc_id", "left_anti").select("query_id", "doc_id")


def inconsistent_answerability(queries: DataFrame) -> DataFrame:
    return queries.filter((F.size("answers") == 0) != (F.size("relevant_ids") == 0)).select("query_id", F.size("answers").alias("answers"), F.size("relevant_ids").alias("relevant"))


def missing_gold_answers(queries: DataFrame, corpus: DataFrame) -> DataFrame:
    """(query_id, answer): answers that stand, case ignored, in none of the relevant documents."""
    each = queries.select("query_id", F.explode("answers").alias("answer"), "relevant_ids").select("query_id", "answer", F.explode_outer("relevant_ids").alias("doc_id"))
    held = each.join(corpus.select("doc_id", F.lower("text").alias("text")), "doc_id", "left")
    found = held.groupBy("query_id", "answer").agg(F.coalesce(F.bool_or(F.contains("text", F.lower("answer"))), F.lit(False)).alias("found"))
    return found.filter("not found").select("query_id", "answer")


def split_overlap(queries: DataFrame, left: str = "dev", right: str = "test", exact: bool = True) -> DataFrame:
    """(kind, key): ids and normalized questions that both splits have."""
    key = question_key("question") if exact else ascii_key(F.col("question"))
    side = lambda s, c: queries.filter(F.col("split") == s).select(c.alias("key")).filter("key is not null and key <> ''")
    ids = side(left, F.col("query_id")).intersect(side(right, F.col("query_id"))).select(F.lit("query_id").alias("kind"), "key")
    same = side(left, key).intersect(side(right, key)).select(F.lit("question").alias("kind"), "key")
    return ids.unionByName(same)


def gold_doc_overlap(queries: DataFrame, left: str = "dev", right: str = "test") -> DataFrame:
    """(doc_id): relevant ids that both splits name."""
    side = lambda s: queries.filter(F.col("split") == s).select(F.explode("relevant_ids").alias("doc_id"))
    return side(left).intersect(side(right))


def evidence_overlap(queries: DataFrame, corpus: DataFrame, left: str = "dev", right: str = "test", exact: bool = True) -> DataFrame:
    """(content): normalized texts of relevant documents that both splits rest on; unknown ids are left to ``unknown_gold``."""
    key = question_key("text") if exact else ascii_key(F.col("text"))
    keyed = corpus.select("doc_id", F.sha2(key, 256).alias("content"))
    side = lambda s: queries.filter(F.col("split") == s).select(F.explode("relevant_ids").alias("doc_id")).distinct().join(keyed, "doc_id").select("content")
    return side(left).intersect(side(right))


def split_policy(queries: DataFrame, corpus: DataFrame, policy: str = "document") -> DataFrame:
    """(kind, key): what the policy forbids two splits to share; ``query`` looks at ids and questions only."""
    if policy not in ("document", "query"):
        raise ValueError("policy must be document or query")
    own = split_overlap(queries)
    if policy == "query":
        return own
    docs = gold_doc_overlap(queries).select(F.lit("gold id").alias("kind"), F.col("doc_id").alias("key"))
    return own.unionByName(docs).unionByName(evidence_overlap(queries, corpus).select(F.lit("evidence").alias("kind"), F.col("content").alias("key")))


def coverage_check(rows: DataFrame, expected: DataFrame, key: str = "query_id", by: tuple[str, ...] = ()) -> DataFrame:
    """(by..., key, side): ids that only the rows, or only the expected set, have."""
    cols = [*by, key]
    a, b = rows.select(*cols).distinct().withColumn("_a", F.lit(True)), expected.select(*cols).distinct().withColumn("_b", F.lit(True))
    return a.join(b, cols, "full_outer").filter("_a is null or _b is null").select(*cols, F.when(F.col("_a").isNull(), "missing").otherwise("unexpected").alias("side"))


def invalid_evaluation_rows(rows: DataFrame, key: str = "attempt_id") -> DataFrame:
    """(rule, rows): how many evaluation rows break each rule, in one pass."""
    ids = F.col("ranked_ids")
    rules = {
        "confidence": ~(finite(F.col("confidence")) & F.col("confidence").between(0, 1)),
        "ranked_ids repeated": F.size(F.array_distinct(ids)) != F.size(ids),
        "ranked_ids blank": ~F.forall(ids, has_answer),
        "answer missing": F.col("raw_answer").isNull(),
        **{c: ~(finite(F.col(c)) & (F.col(c) >= 0)) for c in ("retrieval_ms", "reader_ms", "total_ms")},
    }
    counts = rows.agg(*[F.count_if(F.coalesce(v, F.lit(True))).alias(f"r{i}") for i, v in enumerate(rules.values())])
    pairs = F.array(*[F.struct(F.lit(r).alias("rule"), F.col(f"r{i}").alias("rows")) for i, r in enumerate(rules)])
    return counts.select(F.explode(pairs).alias("x")).select("x.rule", "x.rows")


def audit_corpus(corpus: DataFrame) -> DataFrame:
    """All violations of a corpus."""
    return bad_identifiers(corpus, "doc_id").unionByName(bad_texts(corpus, "doc_id", "title")).unionByName(bad_texts(corpus, "doc_id", "text")).unionByName(duplicates(corpus, "doc_id"))


def audit_queries(queries: DataFrame, corpus: DataFrame) -> DataFrame:
    """All violations of labelled questions."""
    out = bad_identifiers(queries, "query_id").unionByName(bad_texts(queries, "query_id", "question", QUESTION_LIMIT)).unionByName(duplicates(queries, "query_id"))
    out = out.unionByName(_violations("unknown document", unknown_gold(queries, corpus), "query_id", F.col("doc_id")))
    out = out.unionByName(_violations("answerability", inconsistent_answerability(queries), "query_id"))
    out = out.unionByName(_violations("answer not in evidence", missing_gold_answers(queries, corpus), "query_id", F.col("answer")))
    return out.unionByName(_violations("repeated question", duplicate_questions(queries), "key", F.col("split")))


def assert_valid(violations: DataFrame, limit: int = 5) -> None:
    """Raises ValueError that names the first violations, if there are any."""
    rows = violations.orderBy("rule", "key").limit(limit).collect()
    if rows:
        raise ValueError("; ".join(f"{r['rule']}: {r['key']}" for r in rows))
