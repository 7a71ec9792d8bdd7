"""Registered queries on small fixtures, held against plain Python."""

import hashlib
import re
import unicodedata
from collections import Counter
from datetime import datetime

import numpy as np
import pyarrow as pa
import pytest

from querent import catalog
from querent.operators import audit, bm25, compare

QUERIES = "query_id string, question string, relevant_ids array<string>, answers array<string>, split string, source string, created_at timestamp"
CORPUS = "doc_id string, title string, text string, source string"


def key(x):
    return " ".join(unicodedata.normalize("NFKC", x).casefold().split())


def ask(query_id, question, split, relevant=(), answers=()):
    return query_id, question, list(relevant), list(answers), split, "s", datetime(2026, 1, 1)


def tables(spark, path, queries, corpus=()):
    spark.createDataFrame(queries, QUERIES).write.parquet(f"{path}/queries.parquet")
    spark.createDataFrame(list(corpus), CORPUS).write.parquet(f"{path}/corpus.parquet")
    return str(path)


#: Full-width, decomposed, sharp s, ligature, no-break space, final sigma: each pair is one text to the reference.
VARIANTS = [("Ｗhat form", "what form"), ("café hours", "CAFÉ hours"), ("Straße", "STRASSE"), ("ofﬁce", "office"), ("two  words", "two words"), ("οδος", "ΟΔΟΣ"), ("plain", "other")]


@pytest.fixture(scope="module")
def variants(spark, tmp_path_factory):
    rows, docs = [], []
    for i, (a, b) in enumerate(VARIANTS):
        docs += [(f"a{i}", "t", a, "s"), (f"b{i}", "t", b, "s")]
        rows += [ask(f"d{i}", a, "dev", [f"a{i}"]), ask(f"t{i}", b, "test", [f"b{i}"]), ask(f"x{i}", a, "train"), ask(f"y{i}", b, "train")]
    rows += [ask("n", None, "train"), ask("e", " ", "train"), ask("f", "　", "train")]
    return tables(spark, tmp_path_factory.mktemp("variants"), rows, docs)


def test_questions_and_evidence_compare_by_the_full_key(spark, variants):
    run = lambda name: sorted(tuple(r) for r in catalog.queries()[name](spark, variants).collect())
    same = sorted({key(a) for a, b in VARIANTS if key(a) == key(b)})
    assert len(same) == len(VARIANTS) - 1
    assert run("dup_question") == [("train", k, 2) for k in same]
    assert run("split_overlap") == [("question", k) for k in same]
    assert run("evidence_overlap") == sorted((hashlib.sha256(k.encode()).hexdigest(),) for k in same)


def test_spans_of_every_gold_answer(spark, tmp_path):
    docs = [("a", "t", "aaa and maps, maps", "s"), ("b", "t", "keys or maps", "s"), ("c", "t", None, "s")]
    asked = [("q1", ["a", "b"], ["keys", "maps"]), ("q2", ["a"], ["aa", "zz", "and"]), ("q3", ["c", "none"], ["x", "y"]), ("q4", ["a"], []), ("q5", [], ["maps"])]
    sf = tables(spark, tmp_path, [ask(q, "?", "dev", d, a) for q, d, a in asked], docs)
    text = {d: t or "" for d, _, t, _ in docs}
    want = [(q, d, a, i, i + len(a)) for q, ds, golds in asked for d in ds for a in golds for i in range(len(text.get(d, ""))) if text[d].startswith(a, i)]
    assert sorted(tuple(r) for r in catalog.queries()["answer_spans"](spark, sf).collect()) == sorted(want) and len(want) == 7


def test_interval_of_paired_differences(spark):
    diffs = [1.0, 0.0, -1.0, 1.0, 1.0] * 20
    side = lambda sign: spark.createDataFrame([(str(i), max(0.0, sign * d)) for i, d in enumerate(diffs)], "query_id string, answer_em double")
    got = compare.paired_interval(side(1), side(-1)).first()
    want = compare.bootstrap_values(diffs, seed=3)
    assert (got["estimate"], got["wins"], got["ties"], got["losses"], got["unpaired"]) == (0.4, 60, 20, 20, 0)
    assert abs(got["lower"] - want["lower"]) < 0.05 and abs(got["upper"] - want["upper"]) < 0.05


def test_coverage_of_every_experiment(spark):
    rows = spark.createDataFrame([("a", "q1"), ("b", "q2"), ("b", "q3")], "experiment string, query_id string")
    expected = spark.createDataFrame([(e, q) for e in "abc" for q in ("q1", "q2")], "experiment string, query_id string")
    want = [("a", "q2", "missing"), ("b", "q1", "missing"), ("b", "q3", "unexpected"), ("c", "q1", "missing"), ("c", "q2", "missing")]
    assert sorted(tuple(r) for r in audit.coverage_check(rows, expected, by=("experiment",)).collect()) == want


def words(text):
    return set(re.findall(r"\w+", (text or "").lower()))


@pytest.fixture(scope="module")
def shared_words(spark, tmp_path_factory):
    """Texts and questions of which most share a word; also null, blank and repeated ones, and words that stand in titles only."""
    texts = [None, "", " - ", "The THE the"] + [f"the text {i % 7} has w{i}" for i in range(200)]
    docs = [(f"d{i}", None if i % 5 == 0 else f"title t{i % 3}", t, "s") for i, t in enumerate(texts)]
    asked = [None, "", "?", "nothing asked", "THE", "title", "t1 or w7", "w3 w4, w3"] + [f"the w{i} and {i % 9}" for i in range(90)]
    rows = [ask(f"q{i}", q, "test" if i % 2 else "dev") for i, q in enumerate(asked)]
    return tables(spark, tmp_path_factory.mktemp("shared"), rows, docs), rows, docs


@pytest.mark.parametrize(("name", "splits", "titles"), [("bm25_candidates_all", ("test", "dev"), True), ("bm25_candidates", ("test",), False)])
def test_candidates_are_counted_without_pairs(spark, shared_words, name, splits, titles):
    sf, rows, docs = shared_words
    have = [words(text) | (words(title) if titles else set()) for _, title, text, _ in docs]
    counts = {r[0]: sum(bool(words(r[1]) & h) for h in have) for r in rows if r[4] in splits}
    df = catalog.queries()[name](spark, sf)
    assert {tuple(r) for r in df.select("query_id", "candidates").collect()} == {(q, n) for q, n in counts.items() if n} and max(counts.values()) > 190
    # a join of questions and documents by word makes a row for each pair and shared word
    assert "Join" not in df._jdf.queryExecution().executedPlan().toString()


def test_candidate_counts_of_small_blocks(spark, monkeypatch):
    docs = [(f"d{i}", f"t{i % 4}", f"w{i % 3} v{i % 50}") for i in range(300)]
    asked = [(f"q{i}", f"w{i % 3} x{i}" if i % 2 else f"v{i} t{i}") for i in range(60)] + [("q0", "w1"), ("e", None)]
    corpus, queries = spark.createDataFrame(docs, "doc_id string, title string, text string"), spark.createDataFrame(asked, "query_id string, question string")
    pairs = Counter(r["query_id"] for r in bm25.candidates(queries, corpus).collect())
    for size, together, visited in ((1, 4096, 64), (64, 3, 2), (70, 16, 64), (8192, 1, 3)):
        monkeypatch.setattr(bm25, "COUNTED_QUERIES", together)
        monkeypatch.setattr(bm25, "VISITED", visited)
        assert {tuple(r) for r in bm25.candidate_counts(queries, corpus, block_docs=size).collect()} == set(pairs.items())
    assert bm25.candidate_counts(queries.limit(0), corpus).count() == bm25.candidate_counts(queries, corpus.limit(0)).count() == 0
    with pytest.raises(ValueError):
        bm25.candidate_counts(queries, corpus, block_docs=32_768)


def test_united_words_of_a_block_in_parts(monkeypatch):
    rng = np.random.default_rng(3)
    documents, terms = 130, 40
    have = [np.unique(np.r_[rng.integers(documents), np.flatnonzero(rng.random(documents) < share)]) for share in rng.random(terms) ** 3]
    have[0], have[1] = np.arange(documents), np.array([63, 64, 129])
    start, doc = np.cumsum([0, *map(len, have)]).astype(np.int32), np.concatenate(have).astype(np.int16)
    place = np.r_[rng.permutation(terms), [-1] * 5].astype(np.int32)
    size = rng.integers(0, 6, 50)
    code = rng.integers(0, len(place), size.sum()).astype(np.int32)
    want = [len(set().union(*(have[t] for t in place[c] if t >= 0))) for c in np.split(code, np.cumsum(size)[:-1])]
    for some, together in ((32_768, 512), (7, 512), (7, 3), (1, 1)):
        monkeypatch.setattr(bm25, "COUNTED_TERMS", some)
        monkeypatch.setattr(bm25, "UNITED_QUERIES", together)
        assert bm25._united(place, code, size, start, doc, documents).tolist() == want


def test_blocks_of_counted_words_have_bounded_size():
    lists = [["a", "b"], None, [], ["b"], ["c", "a"], ["d"], ["b", "e"]] * 100
    batches = [pa.RecordBatch.from_arrays([pa.array(lists[lo : lo + 150], pa.list_(pa.string()))], ["words"]) for lo in range(0, len(lists), 150)]
    for size, most in ((1, 10), (64, 10_000), (8192, 300), (8192, 10_000)):
        got, n = [], 0
        for b in bm25._terms_of_blocks(size, most)(iter(batches)):
            term, start, doc = (b[c][0].as_py() for c in ("term", "start", "doc"))
            got += sorted((n + d, t) for i, t in enumerate(term) for d in doc[start[i] : start[i + 1]])
            assert b["documents"][0].as_py() <= size and all(doc[a:z] == sorted(doc[a:z]) for a, z in zip(start, start[1:]))
            n += b["documents"][0].as_py()
        assert n == len(lists) and got == [(i, t) for i, x in enumerate(lists) for t in sorted(x or [])]
