"""Mixing sources to target weights by subset-sum budget fitting over token-length counts."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from querent.llm.tokens import VOCABULARY, encode
from querent.plans.skew import global_rank
from querent.plans.staging import Stage
from querent.plans.workers import ship

#: Most tokens that are left for the exact fit, unless a single text is longer; and how many of the longest text that is at most.
EXACT, LONGEST = 1 << 16, 8


def _spread_shares(counts: dict[int, int], budget: int) -> dict[int, int]:
    """Texts of each length in proportion to ``budget``; what a length gives too little, the next length makes up.

    The fractions are carried on from length to length in tokens, so the sum stays within one text of
    the budget and texts of all lengths are taken as often as they occur.
    """
    available = sum(n * c for n, c in counts.items())
    take, owed = {}, 0
    for n in sorted(n for n in counts if n > 0):
        owed += n * counts[n] * budget
        take[n] = min(counts[n], owed // (n * available))
        owed -= take[n] * n * available
    return take


def fit_budget(counts: dict[int, int], budget: int, seed: int = 3) -> dict[int, int]:
    """How many texts of each length to take so that their sum is as near below ``budget`` as it can be.

    The larger part of a budget is taken in proportion to the lengths as they occur. What is left, a
    few times the longest text, is fitted by a bounded-knapsack table of reachable sums (bits of an
    integer), to which the lengths come in a seeded order; its layers tell which copies were taken.
    Budgets below that are left to the table, but for the whole share of each length.
    """
    available = sum(n * c for n, c in counts.items())
    if budget >= available:
        return dict(counts)
    if budget <= 0:
        return {}
    left = min(EXACT, LONGEST * max(counts))
    take = {n: c * budget // available for n, c in counts.items() if n > 0}
    if budget > left:
        take = _spread_shares(counts, budget - left)
    rest = budget - sum(n * c for n, c in take.items())
    spare = {n: c - take[n] for n, c in counts.items() if n > 0}
    full = (1 << (rest + 1)) - 1
    layers: list[tuple[int, int, int]] = []
    reach = 1
    for n in sorted((n for n in spare if 0 < n <= rest), key=lambda n: sha256(f"{seed} {n}".encode()).digest()):
        left, part = min(spare[n], rest // n), 1
        while left:
            part = min(part, left)
            layers.append((n, part, reach))
            reach |= (reach << (n * part)) & full
            left -= part
            part *= 2
        if reach >> rest & 1:
            break
    best = reach.bit_length() - 1
    for n, part, before in reversed(layers):
        if not before >> best & 1:
            take[n] += part
            best -= n * part
    return {n: c for n, c in take.items() if c}


def _sizes(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array([len(encode(t, path)) for t in b.column(3).to_pylist()], pa.int64())], ["doc", "source", "text_key", "tokens"])

    return run


class Mixture:
    """``chosen`` (doc, source, tokens, uses) and ``shares``, the report by source."""

    def __init__(self, chosen: DataFrame, shares: DataFrame) -> None:
        self.chosen, self.shares = chosen, shares


def mix_sources(df: DataFrame, targets: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", total_tokens: int | None = None, seed: int = 3, vocabulary: str = VOCABULARY) -> Mixture:
    """Chooses texts so that each source has its target share of ``total_tokens``.

    Sources compare without outer blanks and case. A text that stands in several rows is one text, of
    the row with the smallest id, and is used at most its source's ``max_repeats`` times. A source that
    can't reach its share is used as often as it may be and reported short. Without ``total_tokens``
    the total is what the listed sources hold once. Null ids, sources and texts, blank texts, and targets that are
    null or not positive take no part; a source listed twice counts with the sum of its shares.
    """
    spark = df.sparkSession
    stage = Stage(spark, "mixing")
    kind = df.schema[id_col].dataType.simpleString()
    name = lambda c: F.lower(F.trim(F.col(c).cast("string")))
    wanted = targets.select(name("source").alias("source"), F.col("target_share").cast("double").alias("share"), F.coalesce(F.col("max_repeats"), F.lit(1)).alias("repeats"))
    wanted = {r["source"]: (r["share"], max(0, r["repeats"])) for r in wanted.filter("source is not null and share > 0").groupBy("source").agg(F.sum("share").alias("share"), F.max("repeats").alias("repeats")).collect()}
    whole = sum(s for s, _ in wanted.values()) or 1.0

    given = df.select(F.col(id_col).alias("doc"), name(source_col).alias("source"), F.sha2(F.col(text_col), 256).alias("text_key"), F.col(text_col).cast("string").alias("text"))
    given = given.filter(F.col("doc").isNotNull() & F.col("source").isin(list(wanted)) & F.col("text").rlike(r"(?U)[^\s\x1c-\x1f]"))
    sized = given.mapInArrow(_sizes(ship(spark, vocabulary)), f"doc {kind}, source string, text_key string, tokens long")
    texts = sized.groupBy("text_key").agg(F.min(F.struct("doc", "source", "tokens")).alias("x")).select("x.*")
    texts = stage.write(texts.withColumn("order", F.xxhash64("doc", F.lit(seed))), "texts")

    # with T tokens a source has fewer than sqrt(2 T) different lengths
    counts: dict[str, dict[int, int]] = {}
    for r in texts.groupBy("source", "tokens").count().collect():
        counts.setdefault(r["source"], {})[r["tokens"]] = r["count"]
    held = {s: sum(n * c for n, c in counts.get(s, {}).items()) for s in wanted}
    total = sum(held.values()) if total_tokens is None else total_tokens
    plan, reached = [], {}
    for s, (share, repeats) in sorted(wanted.items()):
        budget = int(round(total * share / whole))
        rounds = min(repeats, budget // held[s]) if held[s] else 0
        extra = fit_budget(counts.get(s, {}), budget - rounds * held[s], seed) if held[s] and rounds < repeats else {}
        plan += [(s, n, rounds, extra.get(n, 0)) for n in counts.get(s, {})]
        reached[s] = (share / whole, budget, held[s], repeats, rounds * held[s] + sum(n * c for n, c in extra.items()))
    table = spark.createDataFrame(plan, "source string, tokens bigint, rounds bigint, extra bigint")
    ranked = global_rank(stage, texts, ["source", "tokens"], ["order", "doc"])
    uses = F.col("rounds") + F.when(F.col("rank") < F.col("extra"), 1).otherwise(0)
    chosen = ranked.join(table, ["source", "tokens"]).withColumn("uses", uses.cast("long")).filter("uses > 0").select("doc", "source", "tokens", "uses")
    got = sum(r[4] for r in reached.values())
    rows = [(s, *r[:2], r[2], r[3], r[4], r[4] / got if got else None, r[4] >= 0.99 * r[1]) for s, r in reached.items()]
    shares = spark.createDataFrame(rows, "source string, target_share double, target_tokens bigint, held_tokens bigint, max_repeats bigint, reached_tokens bigint, reached_share double, met boolean")
    return Mixture(chosen, shares)
