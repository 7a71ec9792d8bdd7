import math
import re
import unicodedata
from collections import Counter, defaultdict

import pytest

from querent.llm import terms as M

from .helpers import frame

S = "doc_id string, title string, text string, doc string, term string, tf int"


def brute(rows):
    docs = {}
    for i, a, b, *_ in rows:
        if i is not None:
            c = Counter()
            for t in (a or "", b or ""):
                t = "".join(ch for ch in unicodedata.normalize("NFKC", t) if unicodedata.category(ch) != "Cf").lower()
                c.update(re.findall("[a-zß-öø-ɏ]{4,}", t))
            docs[i] = c
    df = defaultdict(int)
    for c in docs.values():
        for t in c:
            df[t] += 1
    mean = sum(sum(c.values()) for c in docs.values()) / max(1, len(docs))
    return {(i, t): (f, df[t], math.log(1 + (len(docs) - df[t] + 0.5) / (df[t] + 0.5)) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * sum(c.values()) / mean))) for i, c in docs.items() for t, f in c.items()}


def test_scores_equal_the_definition(spark):
    rows = [(f"d{i}", "Ｆull WIDTH ×÷ Straße", "common words " * (i % 3) + f"unique{'abcdefghij'[i % 10]} na​ïve ÉTÉS", "c", "c", 1) for i in range(60)]
    rows += [("d0", *rows[0][1:])] * 3 + [("empty", "", None, None, None, None), (None, "lost words", "x", None, None, None), ("long", "t", "lorem ipsum dolor " * 20_000, None, None, None)]
    got = {(r["doc"], r["term"]): (r["tf"], r["df"], r["score"]) for r in M.distinctive_terms(frame(spark, rows, S)).collect()}
    want = brute(rows)
    assert set(got) == set(want)
    for k, v in want.items():
        assert got[k][:2] == v[:2] and got[k][2] == pytest.approx(v[2])


def test_hot_terms_take_the_broadcast_side(spark):
    rows = [(f"d{i:04}", None, "everywhere " + f"term{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}", None, None, None) for i in range(1500)]
    got = {r["term"]: r["df"] for r in M.distinctive_terms(frame(spark, rows, S)).collect()}
    assert got["everywhere"] == 1500


def test_empty(spark):
    assert M.distinctive_terms(frame(spark, [], S)).count() == 0
