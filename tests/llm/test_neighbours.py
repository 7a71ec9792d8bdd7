import numpy as np
import pytest
from pyspark.sql import functions as F

from querent.llm import neighbours as N

from .helpers import frame, tuples

SCHEMA = "id string, vec_id long, embedding array<float>, note string"


def vectors(spark, x, first=1):
    return frame(spark, [("clash", i + first, [float(v) for v in row], None) for i, row in enumerate(x)], SCHEMA)


def brute(x, k):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -9)
    return np.argsort(-s, axis=1)[:, :k] + 1, s


@pytest.fixture(scope="module")
def clustered():
    rng = np.random.default_rng(1)
    centres = rng.standard_normal((12, 16)) * 2
    return (centres[rng.integers(0, 12, 1500)] + rng.standard_normal((1500, 16))).astype(np.float32)


@pytest.fixture(scope="module")
def graph(spark, clustered):
    # small blocks and homes, so that rounds have to fetch from elsewhere
    return N.build_graph(vectors(spark, clustered), dims=16, block_rows=100, home_rows=150, orders=2)


def test_recall_against_brute_force(graph, clustered):
    want, _ = brute(clustered, 5)
    got = {}
    for r in N.most_similar(graph, 5).collect():
        got.setdefault(r["id"], set()).add(r["other"])
    recall = np.mean([len(got[i + 1] & set(w)) / 5 for i, w in enumerate(want)])
    assert recall >= 0.9 and all(len(v) == 5 for v in got.values()) and len(got) == 1500
    assert len(graph.rounds) > 1 and graph.rounds[-1] < graph.rounds[0]


def test_greedy_search_recall(spark, graph, clustered):
    want, _ = brute(clustered, 5)
    got = {}
    for r in N.greedy_search(graph, vectors(spark, clustered).filter("vec_id % 50 = 0"), 5).collect():
        got.setdefault(r["query"], set()).add(r["id"])
    recall = np.mean([len(v & set(want[i - 1])) / 5 for i, v in got.items()])
    assert len(got) == 30 and recall >= 0.9


def test_hot_group_of_copies_and_repeated_rows(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((60, 8)).astype(np.float32)
    x[20:40] = x[20]  # a third of all rows
    df = vectors(spark, x)
    pairs = tuples(N.similar_pairs(df.unionByName(df.limit(30)), dims=8, k=5))
    assert pairs == tuples(N.similar_pairs(df, dims=8, k=5))
    own = [(a, b) for a, b in pairs if 21 <= a <= 40 and 21 <= b <= 40]
    # each copy is paired with the five other copies with the smallest ids
    assert {p for p in own} == {(min(a, b), max(a, b)) for a in range(21, 41) for b in [i for i in range(21, 41) if i != a][:5]}


def test_pairs_at_the_line_are_exact(spark):
    t = float(np.arccos(0.9))
    x = [[1.0, 0.0], [float(np.cos(t * 0.9999)), float(np.sin(t * 0.9999))], [float(np.cos(t * 1.0001)), -float(np.sin(t * 1.0001))]]
    assert tuples(N.similar_pairs(frame(spark, [("c", i, r, None) for i, r in enumerate(x)], "id string, vec_id long, embedding array<double>, n string"), dims=2)) == [(0, 1)]


def test_unusable_vectors_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [("a", 1, [1.0, 0.0], None), ("a", 2, [1e30, 1e28], None), ("a", 3, None, None), ("a", 4, [0.0, 0.0], None), ("a", 5, [nan, 1.0], None), ("a", 6, [inf, 1.0], None), ("a", 7, [1.0], None), ("a", None, [1.0, 0.0], None), ("a", 8, [1.0, None], None)]
    assert tuples(N.similar_pairs(frame(spark, rows, SCHEMA), dims=2)) == [(1, 2)]


@pytest.mark.parametrize("n", [0, 1])
def test_empty_and_single(spark, n):
    df = vectors(spark, np.ones((n, 4), np.float32))
    assert N.similar_pairs(df, dims=4).count() == 0
    g = N.build_graph(df, dims=4)
    assert N.greedy_search(g, df, 5).count() == 0


def test_wide_rows_give_the_exact_top():
    s = np.random.default_rng(3).standard_normal((40, 1003)).astype(np.float32)
    at = N._top(s, 12)
    assert np.allclose(np.take_along_axis(s, at, 1), -np.sort(-s, axis=1)[:, :12])


def test_search_of_unknown_queries(spark, graph):
    q = frame(spark, [("c", 99999, [1.0] * 16, None), ("c", 99998, None, None)], SCHEMA)
    got = N.greedy_search(graph, q, 3)
    assert got.filter(F.col("query") == 99999).count() == 3 and got.count() == 3
