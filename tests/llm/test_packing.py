import numpy as np
import pytest

from querent.llm import packing as K
from querent.llm.tokens import VOCABULARY, encode

from .helpers import frame

S = "doc_id long, text string, doc string, profile string"
P = "profile string, capacity_tokens long"


def test_every_token_is_packed_once_and_boxes_hold(spark):
    rng = np.random.default_rng(6)
    docs = [(i, "alpha beta gamma delta " * int(rng.integers(1, 60)), "x", "y") for i in range(400)]
    docs += [(900, None, None, None), (901, "", None, None), (902, " \n ", None, None), (3, docs[3][1], "repeat", "y")]
    profiles = frame(spark, [("small", 50), ("big", 1000), ("bad", 0), (None, 9), ("null", None)], P)
    got = K.pack_texts(frame(spark, docs, S), profiles).collect()
    for name, cap in (("small", 50), ("big", 1000)):
        own = [r for r in got if r["profile"] == name]
        boxes, spans = {}, {}
        for r in own:
            boxes[r["container_id"]] = boxes.get(r["container_id"], 0) + r["tok_end"] - r["tok_start"]
            spans.setdefault(r["doc"], []).append((r["tok_start"], r["tok_end"]))
        assert max(boxes.values()) <= cap
        for i, t, *_ in docs:
            size = len(encode(t, VOCABULARY)) if t else 0
            times = 2 if i == 3 else 1
            assert sum(b - a for a, b in spans.get(i, [])) == size * times
            if 0 < size <= cap:
                assert spans[i] == [(0, size)] * times
        total = sum(boxes.values())
        assert total / (len(boxes) * cap) > (0.9 if cap == 50 else 0.8)
    assert {r["profile"] for r in got} == {"small", "big"}


def test_window_packing_is_near_the_bound():
    rng = np.random.default_rng(7)
    sizes, n = rng.integers(1, 400, 20_000), iter(range(10**9))
    packer, load = K.Packer(1024, lambda: next(n)), {}
    for i, s in enumerate(sizes):
        for (size, box) in packer.take(int(s), int(s)):
            load[box] = load.get(box, 0) + size
    for size, box in packer.finish():
        load[box] = load.get(box, 0) + size
    assert sum(load.values()) == sizes.sum() and max(load.values()) <= 1024 and sizes.sum() / (1024 * len(load)) > 0.99


def test_hilbert_neighbours_are_adjacent():
    grid = np.stack(np.meshgrid(*[np.arange(8)] * 3, indexing="ij"), -1).reshape(-1, 3)
    keys = K.hilbert_keys(grid, 3)
    assert sorted(keys) == list(range(512))
    steps = np.abs(np.diff(grid[np.argsort(keys)], axis=0)).sum(axis=1)
    assert (steps == 1).all()


@pytest.mark.parametrize("text", ["x" * 50_000, "<|endoftext|>", "é\ud800", "\0"])
def test_odd_texts_have_tokens(text):
    assert len(encode(text, VOCABULARY)) > 0


def test_empty(spark):
    assert K.pack_texts(frame(spark, [], S), frame(spark, [("a", 10)], P)).count() == 0
    assert K.pack_texts(frame(spark, [(1, "a", None, None)], S), frame(spark, [], P)).count() == 0
