"""Same or near-same records across splits: winnowing fingerprints.

A record is the sequence of its folded words. A rolling hash runs over its ``GRAM`` consecutive words,
and of each window of ``WINDOW`` hashes the smallest is kept with its position. Kept hashes are joined
across the splits; the seeds of a pair of records are chained where both positions rise, the chain is
extended word by word, and what it covers is the pair's alignment.

Two records that share a run of GRAM + WINDOW - 1 words meet that way. Records may share most of their
words without such a run (words moved, or changed here and there), and fingerprints of phrases that
many records have would join them all with each other; those are left out. What the threshold asks
for but no seed can promise comes from an exact filter beside it: of two sets of words in one shared
order, rare first, that share at least t of all their words, the first size - ceil(t size) + 1 have a
word in common. Every pair, from either way, is decided by counting the words that both have.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from querent.llm.terms import folded
from querent.plans.skew import join_on_hot_key
from querent.plans.staging import Stage
from querent.plans.workers import once

THRESHOLD = 0.7
#: Words of a rolling hash, hashes of a window, and classes of records from which on a fingerprint is
#: left to the exact filter.
GRAM, WINDOW, COMMON = 3, 4, 64


def folded_words(text: str | None) -> list[str]:
    """Runs of letters and digits after NFKC, without format characters, case and accents, as they stand."""
    if not text:
        return []
    if not text.isascii():
        text = "".join(c for c in unicodedata.normalize("NFD", folded(text)) if unicodedata.category(c) != "Mn")
    return once(("words",), lambda: re.compile(r"[^\W_]+")).findall(text.lower())


def distinct_words(text: str | None) -> list[str]:
    """The folded words, each once."""
    return sorted(set(folded_words(text)))


@F.pandas_udf(T.StringType())
def _folded_text(s: pd.Series) -> pd.Series:
    return s.map(lambda x: " ".join(folded_words(x)))


def winnowed(hashes: np.ndarray, owner: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Positions of the smallest hash of each window of each owner (the last of equals); windows that are cut short count if the owner has no full one."""
    n = len(hashes)
    if not n:
        return np.zeros(0, int)
    best = np.arange(n)
    full = np.ones(n, bool)
    for step in range(1, window):
        at = np.arange(n) + step
        inside = at < n
        at = np.minimum(at, n - 1)
        inside &= owner[at] == owner
        full &= inside
        better = inside & (hashes[at] <= hashes[best])
        best = np.where(better, at, best)
    first = np.r_[True, owner[1:] != owner[:-1]]
    return np.unique(best[full | first])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(class, hash, pos) of each class's words."""
    for b in batches:
        lists = b.column(1)
        sizes = np.asarray(pa.compute.list_value_length(lists))
        words = lists.flatten().dictionary_encode()
        if not len(words):
            continue
        codes = pd.util.hash_array(np.asarray(words.dictionary.to_pylist(), object))[np.asarray(words.indices)].astype(np.uint64)
        owner = np.repeat(np.arange(len(sizes)), sizes)
        begin = np.repeat(np.cumsum(sizes) - sizes, sizes)
        # records of fewer words than a gram have one hash of all their words
        gram = np.minimum(sizes, GRAM)[owner]
        at = np.flatnonzero(np.arange(len(codes)) - begin + gram <= sizes[owner])
        rolled = np.zeros(len(at), np.uint64)
        for step in range(GRAM):
            inside = step < gram[at]
            rolled = np.where(inside, (rolled + codes[np.minimum(at + step, len(codes) - 1)]) * np.uint64(0x9E3779B97F4A7C15), rolled)
        rolled ^= rolled >> np.uint64(29)
        kept = winnowed(rolled, owner[at])
        # of a hash that a record has several times, the first
        order = np.lexsort((kept, rolled[kept], owner[at][kept]))
        own, value = owner[at][kept][order], rolled[kept][order]
        kept = kept[order][np.r_[True, (own[1:] != own[:-1]) | (value[1:] != value[:-1])]]
        yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(owner[at][kept])), pa.array(rolled[kept].view(np.int64)), pa.array((at - begin[at])[kept].astype(np.int32))], ["class", "hash", "pos"])


def align(a: list[str], b: list[str], seeds: list[tuple[int, int]]) -> int:
    """How many words of both the longest rising chain of seeds covers, extended to either side word by word."""
    seeds = sorted(seeds, key=lambda s: (s[0], -s[1]))
    lowest, ends, before = [], [], []  # for each length of a chain the smallest last position, the seed that has it, and each seed's predecessor
    for i, (_, y) in enumerate(seeds):
        at = bisect_left(lowest, y)
        before.append(ends[at - 1] if at else -1)
        lowest[at : at + 1], ends[at : at + 1] = [y], [i]
    chain, at = [], ends[-1] if ends else -1
    while at >= 0:
        chain.append(seeds[at])
        at = before[at]
    covered, done_a, done_b = 0, 0, 0
    for x, y in reversed(chain):
        if x < done_a or y < done_b or a[x] != b[y]:
            continue
        low = 0
        while x - low > done_a and y - low > done_b and a[x - low - 1] == b[y - low - 1]:
            low += 1
        high = 1
        while x + high < len(a) and y + high < len(b) and a[x + high] == b[y + high]:
            high += 1
        covered, done_a, done_b = covered + low + high, x + high, y + high
    return covered


def _aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        x, y = b.column("a").to_pylist(), b.column("b").to_pylist()
        seeds = [[(s["x"], s["y"]) for s in each] for each in b.column("seeds").to_pylist()]
        covered = pa.array([align(*each) for each in zip(x, y, seeds)], pa.int32())
        yield pa.RecordBatch.from_arrays([b.column("base_class"), b.column("other_class"), covered], ["base_class", "other_class", "covered"])


#: Sizes up to this are told apart, larger ones by steps of this ratio.
EXACT_SIZES, STEP = 32, 1.05


def _size_class(size: Column) -> Column:
    return F.when(size < EXACT_SIZES, size).otherwise(EXACT_SIZES + F.floor(F.log(size / EXACT_SIZES) / F.log(F.lit(STEP)))).cast("int")


def _smallest(size_class: Column) -> Column:
    """At most the smallest size of a class."""
    return F.when(size_class < EXACT_SIZES, size_class).otherwise(F.floor(EXACT_SIZES * F.pow(F.lit(STEP), size_class - EXACT_SIZES)) - 1)


def _by_size(kept: DataFrame, threshold: float, mine: str, theirs: str) -> DataFrame:
    """A row for each class of sizes that a partner at this word can have."""
    size = F.col("size")
    classes = F.sequence(_size_class(F.ceil(size * threshold - 1e-9)), _size_class(F.floor(size / threshold + 1e-9)))
    each = kept.withColumn(mine, _size_class(size)).withColumn(theirs, F.explode(classes))
    need = (size + F.greatest(_smallest(F.col(theirs)), size * threshold)) * (threshold / (1 + threshold)) - 1e-6
    return each.filter(size - F.col("pos") >= need)


def _seeded_pairs(stage: Stage, classes: DataFrame) -> DataFrame:
    """(base_class, other_class, covered): pairs that share a kept fingerprint, and the words that their alignment covers."""
    kept = classes.select("class", "text").mapInArrow(_fingerprints, "class string, hash long, pos int")
    kept = stage.write(kept, "fingerprints")
    common = kept.groupBy("hash").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= COMMON).select("hash")
    sides = classes.select("class", "in_base", "in_others")
    marked = kept.join(common, "hash", "left_anti").join(sides, "class")
    left = marked.filter("in_base").select("hash", F.col("class").alias("base_class"), F.col("pos").alias("x"))
    right = marked.filter("in_others").select("hash", F.col("class").alias("other_class"), F.col("pos").alias("y"))
    seeds = left.join(right, "hash").filter("base_class <> other_class").groupBy("base_class", "other_class").agg(F.collect_list(F.struct("x", "y")).alias("seeds"))
    texts = classes.select("class", "text")
    both = seeds.join(texts.select(F.col("class").alias("base_class"), F.col("text").alias("a")), "base_class").join(texts.select(F.col("class").alias("other_class"), F.col("text").alias("b")), "other_class")
    return stage.write(both.select("base_class", "other_class", "a", "b", "seeds").mapInArrow(_aligned, "base_class string, other_class string, covered int"), "aligned")


def _filtered_pairs(sequences: DataFrame, threshold: float) -> DataFrame:
    """(base_class, other_class): pairs that may reach the threshold, by the words that come first in the shared order."""
    size = F.size("seq")
    window = F.ceil(size * F.lit(threshold) - F.lit(1e-9))
    kept = sequences.select("class", "in_base", "in_others", size.alias("size"), F.posexplode(F.slice("seq", F.lit(1), (size - window + 1).cast("int"))).alias("pos", "x"))
    kept = kept.select("class", "in_base", "in_others", "size", "pos", F.col("x.word").alias("word"))
    # a pair is found at its first shared word, after which enough words must be left on both sides for
    # the sizes of both; with the sizes in the key, common words meet only where they can matter
    left = _by_size(kept.filter("in_base"), threshold, "mine", "theirs").select("word", F.col("mine").alias("x"), F.col("theirs").alias("y"), F.col("class").alias("base_class"))
    right = _by_size(kept.filter("in_others"), threshold, "mine", "theirs").select("word", F.col("theirs").alias("x"), F.col("mine").alias("y"), F.col("class").alias("other_class"))
    return left.join(right, ["word", "x", "y"]).filter(F.col("base_class") != F.col("other_class")).select("base_class", "other_class").distinct()


def cross_split_pairs(df: DataFrame, id_col: str = "query_id", text_col: str = "question", split_col: str = "split", base: str = "train", others: tuple[str, ...] = ("dev", "test"), threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """Near-same records of ``base`` and of the ``others``.

    Returns (pairs, records): pairs (base_class, other_class, shared, words, covered) of classes of
    records with the same words, class with itself included, and records (id, split, class, size,
    folded). ``covered`` are the words of their alignment, null where no fingerprint joined them. A
    class is on both sides if it has rows on both. Null ids and splits, and texts without a word, take
    no part; repeated rows count once; an empty table gives empty frames.
    """
    stage = Stage(df.sparkSession, "overlaps")
    sides = df.filter(F.col(id_col).isNotNull() & F.col(split_col).isin(base, *others)).select(F.col(id_col).cast("string").alias("id"), F.col(split_col).alias("split"), F.col(text_col).cast("string").alias("text"))
    worded = sides.distinct().withColumn("folded", _folded_text("text")).filter("folded <> ''")
    words = F.array_sort(F.array_distinct(F.split("folded", " ")))
    named = stage.write(worded.select("id", "split", F.sha2(F.concat_ws(" ", words), 256).alias("class"), F.size(words).alias("size"), "folded"), "named")
    records = named.distinct()
    classes = named.groupBy("class").agg(F.min("folded").alias("folded"), F.max(F.col("split") == base).alias("in_base"), F.max(F.col("split") != base).alias("in_others"))
    classes = stage.write(classes.select("class", F.split("folded", " ").alias("text"), "in_base", "in_others"), "classes")
    aligned = _seeded_pairs(stage, classes)

    total = classes.count()
    each = classes.select("class", F.explode(F.array_distinct("text")).alias("word"))
    often = each.groupBy("word").agg(F.count(F.lit(1)).alias("df"))
    placed = join_on_hot_key(each, often, "word", hot_at=max(200, total // 200), count_col="df")
    sequences = placed.groupBy("class").agg(F.array_sort(F.collect_list(F.struct("df", "word"))).alias("seq"))
    sequences = stage.write(sequences.join(classes.select("class", "in_base", "in_others"), "class"), "sequences")

    found = _filtered_pairs(sequences, threshold).unionByName(aligned.select("base_class", "other_class")).distinct()
    words = sequences.select("class", F.transform("seq", lambda x: x["word"]).alias("words"))
    both = found.join(words.select(F.col("class").alias("base_class"), F.col("words").alias("a")), "base_class").join(words.select(F.col("class").alias("other_class"), F.col("words").alias("b")), "other_class")
    counted = both.withColumn("shared", F.size(F.array_intersect("a", "b"))).withColumn("words", F.size("a") + F.size("b") - F.col("shared"))
    near = counted.filter(F.col("shared") >= F.col("words") * threshold - 1e-9).select("base_class", "other_class", "shared", "words").join(aligned, ["base_class", "other_class"], "left")
    own = F.size("seq")
    same = sequences.filter("in_base and in_others").select(F.col("class").alias("base_class"), F.col("class").alias("other_class"), own.alias("shared"), own.alias("words"), own.alias("covered"))
    return stage.write(near.unionByName(same), "pairs"), records


def overlapping_ids(df: DataFrame, base: str = "train", others: tuple[str, ...] = ("dev", "test"), threshold: float = THRESHOLD) -> DataFrame:
    """(query_lo, query_hi): ids with near-same questions, one in ``base``, the other in ``others``; an id on both sides is a pair with itself."""
    pairs, records = cross_split_pairs(df, base=base, others=others, threshold=threshold)
    left = records.filter(F.col("split") == base).select(F.col("id").alias("x"), F.col("class").alias("base_class")).distinct()
    right = records.filter(F.col("split") != base).select(F.col("id").alias("y"), F.col("class").alias("other_class")).distinct()
    both = pairs.join(left, "base_class").join(right, "other_class").filter("x <> y")
    # an id on both sides is in the records if any of its rows has a word
    sides = df.filter(F.col("query_id").isNotNull()).groupBy(F.col("query_id").cast("string").alias("id")).agg(F.max(F.col("split") == base).alias("a"), F.max(F.col("split").isin(*others)).alias("b")).filter("a and b")
    itself = records.select("id").distinct().join(sides, "id", "left_semi").select(F.col("id").alias("query_lo"), F.col("id").alias("query_hi"))
    return both.select(F.least("x", "y").alias("query_lo"), F.greatest("x", "y").alias("query_hi")).distinct().unionByName(itself)


def overlap_report(df: DataFrame, base: str = "train", others: tuple[str, ...] = ("dev", "test"), threshold: float = THRESHOLD) -> DataFrame:
    """(split, source, records, overlapping, exact, identical, aligned, mean_coverage): how much of each evaluation split stands in ``base``.

    Counts are of distinct (id, question words) records; coverage is the share of a record's words that
    its best match in ``base`` has. ``exact`` records have the same set of words as one in ``base``,
    ``identical`` ones the same words in the same order and number, ``aligned`` ones a match that a
    fingerprint joined. Sources compare as they are; null is a source of its own.
    """
    pairs, records = cross_split_pairs(df, base=base, others=others, threshold=threshold)
    best = pairs.groupBy(F.col("other_class").alias("class")).agg(F.max("shared").alias("shared"), F.max(F.col("base_class") == F.col("other_class")).alias("exact"), F.max(F.col("covered").isNotNull()).alias("aligned"))
    sources = df.filter(F.col("split").isin(*others)).select(F.col("query_id").cast("string").alias("id"), "split", "source").distinct()
    in_base = records.filter(F.col("split") == base).select("folded").distinct()
    identical = records.filter(F.col("split") != base).join(in_base, "folded", "left_semi").select("id", "split", "class").distinct().withColumn("identical", F.lit(True))
    asked = records.filter(F.col("split") != base).select("id", "split", "class", "size").distinct()
    rows = asked.join(sources, ["id", "split"]).join(best, "class", "left").join(identical, ["id", "split", "class"], "left")
    return rows.groupBy("split", "source").agg(
        F.count(F.lit(1)).alias("records"), F.count("shared").alias("overlapping"), F.count_if("exact").alias("exact"), F.count_if("identical").alias("identical"), F.count_if("aligned").alias("aligned"), F.avg(F.col("shared") / F.col("size")).alias("mean_coverage")
    )
