import itertools
import random

import numpy as np

from querent.llm import overlaps as O

from .helpers import frame, tuples

S = "query_id string, question string, split string, source string, class string, words string"


def brute(rows):
    words = lambda t: set(O.distinct_words(t))
    out = set()
    for (p, t, s, *_), (q, u, r, *_) in itertools.product(rows, rows):
        if p is None or q is None or s != "train" or r not in ("dev", "test"):
            continue
        a, b = words(t), words(u)
        if p == q:
            if any(words(x[1]) for x in rows if x[0] == p):
                out.add((p, p))
        elif a and b and len(a & b) * 10 >= 7 * len(a | b):
            out.add((min(p, q), max(p, q)))
    return sorted(out)


def test_pairs_equal_brute_force(spark):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(40)] + ["the", "of"] * 20
    base = [[rng.choice(vocabulary) for _ in range(rng.randrange(1, 16))] for _ in range(40)]
    rows = []
    for i in range(220):
        own = list(rng.choice(base))
        for _ in range(rng.randrange(0, 4)):
            own[rng.randrange(len(own))] = rng.choice(vocabulary)
        rng.shuffle(own)
        rows.append((f"q{rng.randrange(180):03}", " ".join(own), rng.choice(["train", "train", "dev", "test"]), None, "x", "y"))
    assert tuples(O.overlapping_ids(frame(spark, rows, S))) == brute(rows)


def test_folding_nulls_and_hot_copies(spark):
    rows = [("a", "Café  Ｎaïve​?", "train", "s", None, None), ("b", "naive CAFE", "test", None, None, None), ("c", None, "test", None, None, None), ("d", " ?! ", "train", None, None, None), ("d", "!", "dev", None, None, None), (None, "cafe naive", "train", None, None, None), ("e", "cafe naive", None, None, None, None)]
    rows += [(f"h{i}", "same text here", "train" if i % 2 else "dev", "s", None, None) for i in range(20)] * 2
    got = tuples(O.overlapping_ids(frame(spark, rows, S)))
    assert ("a", "b") in got and len(got) == 1 + 100 and not any("c" in p or "d" in p or "e" in p for p in got)


def test_report_counts(spark):
    rows = [("a", "one two three", "train", "s", None, None), ("b", "three two one", "test", "s", None, None), ("c", "other words", "test", "s", None, None), ("d", "one two three", "dev", None, None, None)]
    got = {(r["split"], r["source"]): (r["records"], r["overlapping"], r["exact"], r["mean_coverage"]) for r in O.overlap_report(frame(spark, rows, S)).collect()}
    assert got == {("test", "s"): (2, 1, 1, 1.0), ("dev", None): (1, 1, 1, 1.0)}


def test_empty_and_very_long(spark):
    assert O.overlapping_ids(frame(spark, [], S)).count() == 0
    long = " ".join(f"w{i}" for i in range(20_000))
    rows = [("a", long, "train", None, None, None), ("b", long + " more", "test", None, None, None)]
    assert tuples(O.overlapping_ids(frame(spark, rows, S))) == [("a", "b")]


def test_winnowing_keeps_a_minimum_of_every_window():
    rng = np.random.default_rng(2)
    hashes = rng.integers(0, 50, 300).astype(np.uint64)
    owner = np.sort(rng.integers(0, 40, 300))
    kept = set(O.winnowed(hashes, owner, 4).tolist())
    for o in np.unique(owner):
        at = np.flatnonzero(owner == o)
        for lo in range(max(1, len(at) - 3)):
            window = at[lo : lo + 4]
            assert {i for i in window if hashes[i] == hashes[window].min()} & kept
    assert len(kept) < 250


def test_alignment_chains_rising_seeds():
    a, b = "p q one two three x four five six".split(), "one two three four five six r".split()
    assert O.align(a, b, [(2, 0), (6, 3)]) == 6 and O.align(a, b, [(2, 3), (6, 0)]) == 0
    assert O.align(a, a, [(i, i) for i in range(7)]) == len(a) and O.align(a, b, []) == 0


def test_fingerprints_find_pairs_before_the_filter(spark):
    rows = [(f"t{i}", f"alpha beta gamma delta epsilon zeta eta theta n{i}", "train", None, None, None) for i in range(5)]
    rows += [("d", "alpha beta gamma delta epsilon zeta eta theta", "dev", None, None, None), ("e", "theta eta zeta alpha gamma epsilon beta delta", "test", None, None, None)]
    pairs, _ = O.cross_split_pairs(frame(spark, rows, S))
    got = sorted((r["shared"], r["words"], r["covered"]) for r in pairs.collect())
    # d and e have the same words: their class is aligned by the text that is first in order
    assert got == [(8, 9, 8)] * 5


def test_a_phrase_of_all_records_joins_nothing_by_itself(spark):
    rows = [(f"q{i:03}", f"where do we keep the old w{i % 90} x{i} y{i}", "train" if i % 2 else "test", None, None, None) for i in range(300)]
    assert tuples(O.overlapping_ids(frame(spark, rows, S))) == brute(rows)
    again = ["word " * 30_000, "word " * 29_000 + "more"]
    got = O.overlap_report(frame(spark, [("a", again[0], "train", None, None, None), ("b", again[1], "test", None, None, None)], S)).collect()
    assert [(r["records"], r["overlapping"]) for r in got] == [(1, 0)]
