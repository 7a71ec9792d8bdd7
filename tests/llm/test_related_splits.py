import random

from querent.llm import related_splits as R
from querent.plans.staging import Stage

from .helpers import frame, tuples

Q = "query_id string, relevant_ids array<string>, group_id string, root string"
C = "doc_id string, superseded_by string, node string"
P = "split_name string, target_share double"


def test_groups_by_hand(spark):
    q = frame(spark, [("b", [" D1 "], None, None), ("a", ["d1", None], None, None), ("c", ["d3"], None, None), ("d", ["unknown"], None, None), ("e", ["UNKNOWN"], None, None), ("f", [], None, None), ("g", None, None, None), (None, ["d1"], None, None), ("b", ["d9"], None, None), ("h", ["d9"], None, None)], Q)
    c = frame(spark, [("d1", "d2 ", None), ("D2", "d3", None), ("d4", None, None), ("d5", "", None)], C)
    got = tuples(R.related_groups(q, c, Stage(spark, "t")).filter("members > 1"), "query_id", "group_id")
    assert got == [("a", "a"), ("b", "a"), ("c", "a"), ("d", "d"), ("e", "d"), ("h", "a")]


def test_components_against_union_find(spark):
    rng = random.Random(5)
    edges = [(f"n{rng.randrange(300):03}", f"n{rng.randrange(300):03}") for _ in range(220)] + [(f"p{i:03}", f"p{i + 1:03}") for i in range(120)]
    par = {}

    def find(x):
        par.setdefault(x, x)
        while par[x] != x:
            x = par[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        par[max(a, b)] = min(a, b)
    got = tuples(R.connected_components(frame(spark, edges + [(None, "n001")], "a string, b string"), Stage(spark, "t")))
    assert got == sorted((n, find(n)) for n in par)


def test_splits_are_near_their_shares_and_keep_groups(spark):
    rng = random.Random(6)
    rows = [(f"q{i:04}", [f"d{rng.randrange(500)}"], None, None) for i in range(900)] + [(f"h{i}", ["hot"], None, None) for i in range(450)]
    plan = frame(spark, [("train", 0.8), ("dev", 0.1), ("test", 0.1)], P)
    got = R.assign_splits(frame(spark, rows, Q), frame(spark, [], C), plan).collect()
    assert len(got) == len({r["query_id"] for r in got}) == 1350
    by_group = {}
    for r in got:
        by_group.setdefault(r["group_id"], set()).add(r["split_name"])
    assert all(len(s) == 1 for s in by_group.values())
    for s, share in (("train", 0.8), ("dev", 0.1), ("test", 0.1)):
        assert abs(sum(r["split_name"] == s for r in got) / 1350 - share) < 0.02
    again = R.assign_splits(frame(spark, rows, Q), frame(spark, [], C), plan).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))


def test_empty_tables(spark):
    assert R.assign_splits(frame(spark, [], Q), frame(spark, [], C), frame(spark, [], P)).count() == 0
    assert R.assign_splits(frame(spark, [("a", None, None, None)], Q), frame(spark, [], C), frame(spark, [("x", None), (None, 1.0)], P)).count() == 1


def test_balance_deals_all_groups_once():
    made = R.balance({1: 1000, 7: 30, 400: 2}, {"a": 0.5, "b": 0.5}, 20)
    count, weight = {}, {"a": 0, "b": 0}
    for w, b, x, y in made.runs:
        assert count.get(w, 0) == x
        count[w] = y
        weight[made.split_of[b]] += w * (y - x)
    assert count == {1: 1000, 7: 30, 400: 2} and abs(weight["a"] - weight["b"]) <= 60
