import itertools
import random

from querent.llm import mixing as M

from .helpers import frame

S = "doc_id long, text string, source string, doc string, tokens string"
T = "source string, target_share double, max_repeats int"


def test_budget_fit_is_the_best_subset_sum():
    rng = random.Random(8)
    for _ in range(60):
        counts = {rng.randrange(3, 40): rng.randrange(1, 4) for _ in range(4)}
        budget = rng.randrange(1, sum(n * c for n, c in counts.items()) + 1)
        got = M.fit_budget(counts, budget)
        assert all(got[n] <= counts[n] for n in got)
        prop = {n: c * budget // sum(a * b for a, b in counts.items()) for n, c in counts.items()}
        best = max(s for take in itertools.product(*[range(prop[n], c + 1) for n, c in counts.items()]) if (s := sum(n * k for n, k in zip(counts, take))) <= budget)
        assert sum(n * c for n, c in got.items()) == best


def test_shares_caps_and_sources(spark):
    rows = [(i, f"text number {i} " + "word " * (i % 17), " Big " if i % 3 else "small", "c", "c") for i in range(600)]
    rows += [(1000 + i, rows[i][1], "small", None, None) for i in range(50)] + [(2000, None, "small", None, None), (2001, "  ", "small", None, None), (2002, "other", None, None, None), (2003, "x y", "unlisted", None, None)]
    targets = frame(spark, [("BIG", 0.5, 1), ("small", 0.45, 3), ("absent", 0.05, 2), ("zero", 0.0, 1), (None, 0.1, 1)], T)
    mix = M.mix_sources(frame(spark, rows, S), targets)
    shares = {r["source"]: r for r in mix.shares.collect()}
    chosen = mix.chosen.collect()
    assert set(shares) == {"big", "small", "absent"} and not shares["absent"]["met"]
    texts = {r[0]: r[1] for r in rows}
    used = {}
    for r in chosen:
        used[texts[r["doc"]]] = used.get(texts[r["doc"]], 0) + r["uses"]
        assert r["uses"] <= (1 if r["source"] == "big" else 3)
    assert len(used) == len(chosen)  # equal texts are one text
    for s in ("big", "small"):
        got = sum(r["tokens"] * r["uses"] for r in chosen if r["source"] == s)
        assert got == shares[s]["reached_tokens"] and shares[s]["target_tokens"] - got <= 3
    again = M.mix_sources(frame(spark, rows, S).repartition(5), targets).chosen.collect()
    assert sorted(map(tuple, chosen)) == sorted(map(tuple, again))


def test_empty(spark):
    assert M.mix_sources(frame(spark, [], S), frame(spark, [("a", 1.0, 2)], T)).chosen.count() == 0
    assert M.mix_sources(frame(spark, [(1, "a", "a", None, None)], S), frame(spark, [], T)).shares.count() == 0
