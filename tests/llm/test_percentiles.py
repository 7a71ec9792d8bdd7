import numpy as np
import pytest
from pyspark.sql import functions as F

from querent.llm import percentiles as P

from .helpers import frame

S = "attempt_id long, experiment string, field string, n int, v double, logged_at string"


@pytest.mark.parametrize("shape", ["lognormal", "uniform", "ties"])
def test_rank_error_is_bounded_after_many_merges(shape):
    rng = np.random.default_rng(4)
    x = {"lognormal": rng.lognormal(size=200_000), "uniform": rng.random(200_000), "ties": rng.integers(0, 50, 200_000).astype(float)}[shape]
    whole = P.RankSketch()
    for part in np.array_split(x, 64):
        s = P.RankSketch()
        for piece in np.array_split(part, 5):
            s.add(piece)
        whole.merge(P.RankSketch.from_bytes(s.to_bytes()))
    assert whole.count == len(x) and len(whole.to_bytes()) < 60_000
    ordered = np.sort(x)
    for share in (0.01, 0.25, 0.5, 0.9, 0.95, 0.99, 0.999, 0.9999):
        (q,) = whole.quantiles([share])
        low, high = np.searchsorted(ordered, q, "left"), np.searchsorted(ordered, q, "right")
        target = share * (len(x) - 1)
        miss = max(0, low - target, target - high)
        assert miss <= P.rank_error() * (len(x) - target + 1), (share, miss)
    assert whole.quantiles([0.0, 1.0]) == [ordered[0], ordered[-1]]


def test_small_groups_are_exact():
    x = np.random.default_rng(5).random(200)
    s = P.RankSketch()
    s.add(x)
    shares = [0.0, 0.1, 0.5, 0.95, 1.0]
    assert s.quantiles(shares) == pytest.approx(list(np.quantile(x, shares)))
    assert P.RankSketch().quantiles([0.5]) == [None]


def test_groups_nulls_placeholders_and_hot_group(spark):
    rows = [(i, "hot" if i % 3 else None, "clash", 1, float(i % 1000), None) for i in range(9000)]
    rows += [(90_001, "odd", "c", 1, v, None) for v in (None, float("nan"), float("inf"), -1.0, 600_000.0)]
    made = P.build_sketches(frame(spark, rows, S).repartition(7), ["experiment"], ["v"], 600_000.0)
    got = {r["experiment"]: (r["n"], r["quantiles"]) for r in P.sketch_quantiles(made, [0.5, 0.95]).collect()}
    assert set(got) == {"hot", None}
    for key in got:
        own = [r[4] for r in rows if r[1] == key and r[4] is not None]
        assert got[key][0] == len(own) and got[key][1] == pytest.approx(list(np.quantile(own, [0.5, 0.95])), rel=0.03)
    assert P.build_sketches(frame(spark, [], S), ["experiment"], ["v"]).count() == 0


def test_days_can_be_combined(spark):
    rows = [(i, f"day{i % 4}", "x", 1, float(i), None) for i in range(2000)]
    made = P.build_sketches(frame(spark, rows, S), ["experiment"], ["v"])
    whole = P.sketch_quantiles(P.merge_sketches(made.drop("n"), ["field"]), [0.5]).first()
    assert whole["n"] == 2000 and whole["quantiles"][0] == pytest.approx(999.5, rel=0.02)


def test_repeated_attempts_count_once(spark):
    rows = [(1, "a", "x", 1, 2.0, "t1"), (1, "a", "x", 1, 2.0, "t2"), (2, "a", "x", 1, 3.0, "t1"), (None, "a", "x", 1, 4.0, None)]
    assert P.distinct_attempts(frame(spark, rows, S), ["experiment", "v"]).agg(F.sum("v")).first()[0] == 9.0
