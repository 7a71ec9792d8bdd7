import random
import re

import pytest

from querent.llm import pieces as P

from .helpers import frame, tuples

S = "doc_id string, text string, start string, parent_id string"


def check(text, limit=512, overlap=64):
    got, unbroken = P.cut_text(text, limit, overlap)
    assert got[0][0] == 0 and got[-1][1] == len(text)
    for (a, b, _), (c, d, _) in zip(got, got[1:]):
        assert a < c <= b < d and b - c <= overlap
    assert all(b - a <= limit for a, b, _ in got)
    return got, unbroken


def test_pieces_cover_and_cut_at_boundaries():
    rng = random.Random(1)
    for _ in range(60):
        words = ["x" * rng.choice([1, 4, 9, 30, 700 if rng.random() < 0.02 else 5]) for _ in range(rng.randrange(1, 900))]
        text = "".join(w + rng.choice([" ", " ", ". ", "\n", "\n\n", "。", "　"]) for w in words)
        got, unbroken = check(text)
        for (a, _, hard) in got[1:]:
            assert hard or P._strengths(text)[a] or any(x <= a <= y for x, y in unbroken)


def test_strongest_boundary_near_the_middle_wins():
    text = "word " * 60 + "end.\n\n" + "word " * 60
    assert check(text)[0][0][1] == text.index("\n\n") + 2


def test_hard_cuts_only_without_boundary():
    got, _ = check("a" * 2000)
    assert all(h for _, _, h in got[1:])
    got, _ = check("é" * 600)
    assert all(("é" * 600)[a] == "e" for a, *_ in got)


def test_runs_equal_a_scan(spark):
    rng = random.Random(2)
    docs = []
    for i in range(40):
        parts = [rng.choice("ab.é") * rng.choice([3, 40, 512, 513, 900]) for _ in range(rng.randrange(1, 9))]
        docs.append((f"d{i}", rng.choice([" ", "\t", "。", "  ", "\r\n"]).join(parts), None, None))
    want = sorted((d, m.start(), m.end()) for d, t, *_ in docs for m in re.finditer("[^" + re.escape(P.BOUNDARY_CHARS) + "]{513,}", t))
    assert tuples(P.unbroken_runs(frame(spark, docs + docs[:5], S))) == want


def test_nulls_empties_and_short_texts(spark):
    df = frame(spark, [("a", None, None, None), ("b", "", None, None), ("c", "short", None, None), (None, "x " * 600, None, None)], S)
    assert P.split_oversized(df).count() == 0 and P.unbroken_runs(df).count() == 0
    assert P.split_oversized(df.limit(0)).count() == 0


def test_very_long_text(spark):
    got, _ = check("Some words here. " * 60_000)
    assert len(got) > 2000


@pytest.mark.parametrize("n", [512, 513])
def test_limit_itself(n):
    assert len(check("a b " * 200 + "c" * n)[0]) > 1 and len(P.cut_text("x" * n)[0]) == (1 if n == 512 else 2)
