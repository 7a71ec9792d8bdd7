"""The queries of this subpackage over the supplied tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from querent.llm import mixing, neighbours, overlaps, packing, percentiles, pieces, related_splits, sentences, terms
from querent.plans.staging import Stage

TIMINGS = ["retrieval_ms", "reader_ms", "total_ms"]
SHARES = [0.5, 0.9, 0.95, 0.99]
#: Timings from this on are placeholders.
CEILING = 600_000.0


def _read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return neighbours.similar_pairs(_read(spark, sf, "dense_index"))


def p1_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    graph = neighbours.build_graph(_read(spark, sf, "dense_index"))
    return neighbours.most_similar(graph, 5).select(F.col("id").alias("vec_id"), F.col("other").alias("neighbour_id"), "rank", F.round("sim", 4).alias("cosine"))


def p1_search(spark: SparkSession, sf: str) -> DataFrame:
    """Every vector whose id is divisible by 50 is a query against all vectors."""
    vectors = _read(spark, sf, "dense_index")
    graph = neighbours.build_graph(vectors)
    found = neighbours.greedy_search(graph, vectors.filter(F.col("vec_id") % 50 == 0), 5)
    return found.select(F.col("query").alias("vec_id"), F.col("id").alias("neighbour_id"), "rank", F.round("sim", 4).alias("cosine"))


def _splits(spark: SparkSession, sf: str) -> DataFrame:
    return related_splits.assign_splits(_read(spark, sf, "queries"), _read(spark, sf, "corpus"), _read(spark, sf, "split_plan"))


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    """The groups of the split assignment that hold several ids."""
    return _splits(spark, sf).filter("members > 1").select("query_id", "group_id")


def p2_splits(spark: SparkSession, sf: str) -> DataFrame:
    return _splits(spark, sf).select("query_id", "group_id", "split_name")


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return pieces.unbroken_runs(_read(spark, sf, "corpus"))


def p3_pieces(spark: SparkSession, sf: str) -> DataFrame:
    return pieces.split_oversized(_read(spark, sf, "corpus")).select("parent_id", "start", "end", "hard")


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return overlaps.overlapping_ids(_read(spark, sf, "queries"))


def p4_report(spark: SparkSession, sf: str) -> DataFrame:
    return overlaps.overlap_report(_read(spark, sf, "queries"))


def _sketches(spark: SparkSession, sf: str) -> DataFrame:
    attempts = percentiles.distinct_attempts(_read(spark, sf, "runner"), ["experiment", "run_day", *TIMINGS])
    return percentiles.build_sketches(attempts, ["experiment", "run_day"], TIMINGS, CEILING)


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    known = _sketches(spark, sf).filter("n >= 20 and experiment is not null and run_day is not null")
    read = percentiles.sketch_quantiles(known, [0.5, 0.95])
    return read.filter(F.col("quantiles")[1] > 3 * F.col("quantiles")[0]).select("experiment", "run_day", "field")


def p5_percentiles(spark: SparkSession, sf: str) -> DataFrame:
    read = percentiles.sketch_quantiles(_sketches(spark, sf), SHARES)
    return read.select("experiment", "run_day", "field", "n", *[F.col("quantiles")[i].alias(f"p{round(s * 100)}") for i, s in enumerate(SHARES)], F.lit(percentiles.rank_error()).alias("rank_error"), "sketch")


def p5_all_days(spark: SparkSession, sf: str) -> DataFrame:
    """The sketches of the days, merged."""
    merged = percentiles.merge_sketches(_sketches(spark, sf).drop("n"), ["experiment", "field"])
    read = percentiles.sketch_quantiles(merged, SHARES)
    return read.select("experiment", "field", "n", *[F.col("quantiles")[i].alias(f"p{round(s * 100)}") for i, s in enumerate(SHARES)])


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    scored = terms.distinctive_terms(_read(spark, sf, "corpus"))
    return scored.filter("tf >= 3 and df <= 4").select(F.col("doc").alias("doc_id"), "term")


def p6_terms(spark: SparkSession, sf: str) -> DataFrame:
    return terms.distinctive_terms(_read(spark, sf, "corpus")).withColumnRenamed("doc", "doc_id")


def p7_packed(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack_texts(_read(spark, sf, "documents"), _read(spark, sf, "pack_profiles")).withColumnRenamed("doc", "doc_id")


def p7_fill(spark: SparkSession, sf: str) -> DataFrame:
    profiles = _read(spark, sf, "pack_profiles")
    return packing.fill_report(packing.pack_texts(_read(spark, sf, "documents"), profiles), profiles)


def p8_mixture(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.mix_sources(_read(spark, sf, "documents"), _read(spark, sf, "mix_targets")).chosen.withColumnRenamed("doc", "doc_id")


def p8_shares(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.mix_sources(_read(spark, sf, "documents"), _read(spark, sf, "mix_targets")).shares


def p2_audit(spark: SparkSession, sf: str) -> DataFrame:
    """Whether each split holds within 0.02 of its share of the rows, and how many groups stand in several splits."""
    placed = Stage(spark, "audit").write(_splits(spark, sf), "placed")
    rows = _read(spark, sf, "queries").filter("query_id is not null").groupBy("query_id").agg(F.count(F.lit(1)).alias("rows"))
    weighed = placed.join(rows, "query_id").groupBy("split_name").agg(F.sum("rows").alias("rows"))
    total = _read(spark, sf, "queries").filter("query_id is not null").agg(F.count(F.lit(1))).scalar()
    torn = placed.groupBy("group_id").agg(F.count_distinct("split_name").alias("n")).agg(F.count_if(F.col("n") > 1)).scalar()
    plan = _read(spark, sf, "split_plan").join(weighed, "split_name", "left")
    near = F.abs(F.coalesce("rows", F.lit(0)) / total - F.col("target_share")) <= 0.02
    return plan.select("split_name", near.alias("near"), torn.alias("torn"))


def p3_audit(spark: SparkSession, sf: str) -> DataFrame:
    """Of each oversized text: where its pieces begin and end, whether they fit, and how many leave a gap."""
    pieces_ = pieces.split_oversized(_read(spark, sf, "corpus"))
    before = F.lag("end").over(Window.partitionBy("parent_id").orderBy("start"))
    seen = pieces_.withColumn("gap", F.col("start") > before)
    return seen.groupBy("parent_id").agg(F.min("start").alias("first"), F.max("end").alias("last"), (F.max(F.col("end") - F.col("start")) <= pieces.LIMIT).alias("fits"), F.count_if("gap").alias("gaps"))


def p5_counts(spark: SparkSession, sf: str) -> DataFrame:
    """How many values each sketch stands for."""
    return _sketches(spark, sf).select("experiment", "run_day", "field", "n")


def p7_audit(spark: SparkSession, sf: str) -> DataFrame:
    """Of each profile: containers over the capacity, and texts that were cut though they fit."""
    profiles = _read(spark, sf, "pack_profiles").select("profile", "capacity_tokens").distinct()
    packed = packing.pack_texts(_read(spark, sf, "documents"), profiles).join(F.broadcast(profiles), "profile")
    size = F.col("tok_end") - F.col("tok_start")
    boxes = packed.groupBy("profile", "container_id").agg((F.sum(size) > F.first("capacity_tokens")).alias("over")).groupBy("profile").agg(F.count_if("over").alias("over"))
    texts = packed.groupBy("profile", "doc").agg((F.count(F.lit(1)) > F.ceil(F.sum(size) / F.first("capacity_tokens"))).alias("cut")).groupBy("profile").agg(F.count_if("cut").alias("cut"))
    return boxes.join(texts, "profile")


def p8_audit(spark: SparkSession, sf: str) -> DataFrame:
    """Of each source that holds texts: texts that are used more often than they may be, and whether the report counts what was chosen."""
    mix = mixing.mix_sources(_read(spark, sf, "documents"), _read(spark, sf, "mix_targets"))
    used = mix.chosen.groupBy("source").agg(F.max("uses").alias("most"), F.sum(F.col("tokens") * F.col("uses")).alias("tokens"))
    both = mix.shares.join(used, "source", "left")
    return both.select("source", (F.coalesce("most", F.lit(0)) > F.col("max_repeats")).alias("over"), (F.coalesce("tokens", F.lit(0)) == F.col("reached_tokens")).alias("counted"))


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    return sentences.sentences(_read(spark, sf, "documents")).withColumnRenamed("doc", "doc_id")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = [p1_found, p1_neighbours, p1_search, p2_found, p2_splits, p3_found, p3_pieces, p4_found, p4_report, p5_found, p5_percentiles, p5_all_days, p6_found, p6_terms, p7_packed, p7_fill, p8_mixture, p8_shares, p9_found, p2_audit, p3_audit, p5_counts, p7_audit, p8_audit]
    return {f.__name__: f for f in named}


def oracle_sql() -> dict[str, str]:
    """SQL for the queries it can express; the others are held against brute force in tests/llm."""
    ok = "{0} IS NOT NULL AND NOT isnan({0}) AND {0} >= 0 AND {0} < 600000"
    fields = " UNION ALL ".join(f"SELECT experiment, run_day, '{f}' AS field, {f} AS v FROM a WHERE {ok.format(f)}" for f in TIMINGS)
    return {
        "p2_audit": "SELECT split_name, true AS near, 0 AS torn FROM split_plan",
        "p3_audit": """SELECT doc_id AS parent_id, 0 AS first, length(text) AS last, true AS fits, 0 AS gaps FROM (SELECT DISTINCT doc_id, text FROM corpus WHERE length(text) > 512 AND doc_id IS NOT NULL)""",
        "p5_counts": f"""WITH a AS (SELECT DISTINCT attempt_id, experiment, run_day, {', '.join(TIMINGS)} FROM runner), u AS ({fields}) SELECT experiment, run_day, field, count(*) AS n FROM u GROUP BY ALL""",
        "p7_audit": "SELECT DISTINCT profile, 0 AS over, 0 AS cut FROM pack_profiles",
        "p8_audit": "SELECT DISTINCT lower(trim(source)) AS source, false AS over, true AS counted FROM mix_targets WHERE target_share > 0",
        "p5_found": f"""
            WITH a AS (SELECT DISTINCT attempt_id, experiment, run_day, {', '.join(TIMINGS)} FROM runner),
            u AS ({fields})
            SELECT experiment, run_day, field FROM u GROUP BY ALL
            HAVING count(*) >= 20 AND quantile_cont(v, 0.95) > 3 * quantile_cont(v, 0.5)
        """,
        "p2_found": r"""
            WITH RECURSIVE named AS (
                SELECT DISTINCT query_id, lower(regexp_replace(d, '^\s+|\s+$', '', 'g')) AS doc
                FROM (SELECT query_id, unnest(relevant_ids) AS d FROM queries) WHERE d IS NOT NULL),
            moved AS (
                SELECT DISTINCT lower(regexp_replace(doc_id, '^\s+|\s+$', '', 'g')) AS a, lower(regexp_replace(superseded_by, '^\s+|\s+$', '', 'g')) AS b
                FROM corpus WHERE doc_id IS NOT NULL AND superseded_by IS NOT NULL AND trim(superseded_by) <> ''),
            edges AS (
                SELECT 'q ' || query_id AS a, 'd ' || doc AS b FROM named UNION SELECT 'd ' || doc, 'q ' || query_id FROM named
                UNION SELECT 'd ' || a, 'd ' || b FROM moved UNION SELECT 'd ' || b, 'd ' || a FROM moved),
            reach AS (SELECT 'q ' || query_id AS s, 'q ' || query_id AS t FROM named UNION SELECT s, b FROM reach JOIN edges ON t = a),
            g AS (SELECT s, min(t) AS g, count(*) AS n FROM reach WHERE t LIKE 'q %' GROUP BY s)
            SELECT substr(s, 3) AS query_id, substr(g, 3) AS group_id FROM g WHERE n > 1
        """,
    }
