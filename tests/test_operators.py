import json
import math

import pytest
from pyspark.sql import functions as F

from querent.operators import audit, bm25, calibration, chunks, compare, dense, metrics, rank, reader, scoring

ROW = "query_id string, raw_answer string, confidence double, answers array<string>, ranked_ids array<string>, relevant_ids array<string>, retrieval_ms double, reader_ms double, total_ms double"


def rows(spark, *items):
    return spark.createDataFrame([(q, a, c, g, r, d, 1.0, 2.0, 3.0) for q, a, c, g, r, d in items], ROW)


@pytest.fixture(scope="module")
def corpus(spark):
    return spark.createDataFrame([("d1", "Aster archive", "The aster archive keeps maps."), ("d2", "Cedar archive", "The cedar archive keeps keys."), ("d3", "Empty", "")], "doc_id string, title string, text string")


def asked(spark, *items):
    return spark.createDataFrame(list(items), "query_id string, question string")


def test_bm25_order_ties_and_empties(spark, corpus):
    got = bm25.search(asked(spark, ("q1", "aster keys"), ("q2", "nothing here"), ("q3", "archive")), corpus).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["doc_id"]) for r in got] == [("q1", "d1"), ("q1", "d2"), ("q3", "d1"), ("q3", "d2")]
    assert all(r["score"] > 0 for r in got)


def test_bm25_equals_the_formula(spark, corpus):
    docs = {"d1": "the aster archive keeps maps".split(), "d2": "the cedar archive keeps keys".split(), "d3": []}
    mean = sum(map(len, docs.values())) / 3
    got = {r["doc_id"]: r["score"] for r in bm25.search(asked(spark, ("q", "aster archive aster")), corpus, title_weight=0.0).collect()}
    want = {}
    for d, words in docs.items():
        score = 0
        for t in {"aster", "archive"}:
            df = sum(t in w for w in docs.values())
            tf = words.count(t)
            score += math.log(1 + (3 - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(words) / mean))
        if score > 0:
            want[d] = score
    assert got == pytest.approx(want)


def test_explain_sums_to_the_score(spark, corpus):
    q = asked(spark, ("q", "aster archive unknown"))
    parts = bm25.explain(q, corpus, "d1").collect()
    score = bm25.search(q, corpus).filter("doc_id = 'd1'").first()["score"]
    assert sum(r["part"] for r in parts) == pytest.approx(score) and len(parts) == 3
    with pytest.raises(ValueError):
        bm25.explain(q, corpus, "nope")


def ranking(spark, *items):
    return spark.createDataFrame([("q", d, r) for d, r in items], "query_id string, doc_id string, rank int")


def test_fusion(spark):
    got = rank.reciprocal_rank_fusion([ranking(spark, ("a", 1), ("b", 2)), ranking(spark, ("b", 1))], [1, 2], 0).orderBy("rank").collect()
    assert [(r["doc_id"], r["score"]) for r in got] == [("b", 2.5), ("a", 1.0)]
    none = rank.reciprocal_rank_fusion([ranking(spark, ("a", 1)), ranking(spark, ("b", 1))], [1, 0])
    assert [r["doc_id"] for r in none.collect()] == ["a"]
    for bad in ([1, -1], [1, math.nan], [1]):
        with pytest.raises(ValueError):
            rank.reciprocal_rank_fusion([ranking(spark, ("a", 1))] * 2, bad)


@pytest.mark.parametrize(("balance", "want"), [(1.0, ["a", "b"]), (0.0, ["a", "c"])])
def test_mmr(spark, balance, want):
    pool = spark.createDataFrame([("q", "a", 1.0, [1.0, 0.0]), ("q", "b", 0.9, [0.9, 0.1]), ("q", "c", 0.0, [0.0, 1.0])], "query_id string, doc_id string, score double, embedding array<double>")
    assert [r["doc_id"] for r in rank.mmr(pool, 2, balance).orderBy("rank").collect()] == want


def test_batch_keeps_queries_without_hits(spark):
    scored = ranking(spark, ("a", 1)).withColumn("score", F.lit(1.0))
    got = {r["query_id"]: len(r["ranked"]) for r in rank.retrieve_batch(asked(spark, ("q", ""), ("r", "")), scored).collect()}
    assert got == {"q": 1, "r": 0}


def test_dense_search_is_exact_with_ties_by_id(spark):
    docs = spark.createDataFrame([(3, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [0.0, 1.0]), (4, None), (5, [0.0, 0.0])], "doc_id long, embedding array<double>")
    qs = spark.createDataFrame([(9, [1e300, 0.0])], "query_id long, embedding array<double>")
    got = dense.search(qs, docs, 2, 2).orderBy("rank").collect()
    assert [(r["doc_id"], r["score"]) for r in got] == [(1, 1.0), (3, 1.0)]
    assert dense.search(qs.limit(0), docs, 2, 2).count() == 0


def test_encoder_contract():
    enc = dense.HashedEncoder(32)
    assert abs((enc.encode(["a b", "c"]) ** 2).sum() - 2) < 1e-5
    for bad in ("text", [""], [1]):
        with pytest.raises(ValueError):
            enc.encode(bad)
    with pytest.raises(ValueError):
        dense.EncoderConfig(pooling="max")


def test_chunks(spark):
    doc = spark.createDataFrame([("d", "t", "abcdefghijk"), ("e", "t", "ab"), ("n", "t", None)], "doc_id string, title string, text string")
    got = [(r["parent_id"], r["start"], r["end"], r["text"]) for r in chunks.chunk(doc, 5, 2).orderBy("parent_id", "start").collect()]
    assert got == [("d", 0, 5, "abcde"), ("d", 3, 8, "defgh"), ("d", 6, 11, "ghijk"), ("e", 0, 2, "ab")]
    hits = spark.createDataFrame([("q", "c1", 2.0, 1), ("q", "c2", 1.5, 2), ("q", "c3", 1.8, 3)], "query_id string, chunk_id string, score double, rank int")
    parts = spark.createDataFrame([("c1", "a", 0, 5), ("c2", "b", 0, 5), ("c3", "b", 3, 8)], 'chunk_id string, parent_id string, start int, end int')
    best = {p: chunks.aggregate_chunks(hits, parts, p).orderBy("rank").first() for p in ("max", "sum")}
    assert best["max"]["doc_id"] == "a" and best["sum"]["doc_id"] == "b"
    assert best["sum"]["best_chunk"] == "c3" and best["sum"]["chunk_ids"] == ["c2", "c3"]


def test_failures_in_order_of_attribution(spark):
    r = rows(spark, ("q1", "wrong", 0.9, ["x"], ["a"], ["a"]), ("q2", "x", 0.9, ["x"], ["b"], ["a"]), ("q3", "", 0.9, [], ["b"], []), ("q4", "x", 0.9, [], ["b"], []), ("q5", "", 0.9, ["x"], ["a"], ["a"]), ("q6", "x", 0.9, ["x"], ["a"], ["a"]), ("q7", "x", 0.1, ["x"], ["a"], ["a"]))
    got = [x["failure"] for x in scoring.scored(r, 0.5).orderBy("query_id").collect()]
    assert got == ["reader_failure", "retrieval_miss", "correct_abstention", "unanswerable_false_positive", "false_abstention", "correct", "false_abstention"]
    m = scoring.score_predictions(r.filter("query_id = 'q3'"), 0.5).first()
    assert m["selective_em"] is None and m["answerable_em"] is None and m["correct"] == 0


def test_ranking_metrics(spark):
    df = spark.createDataFrame([(["a", "x", "b"], ["a", "b"]), (["x", "y", "z", "w", "a"], ["a"]), (["x"], [])], "r array<string>, g array<string>")
    got = df.select(metrics.average_precision(F.col("r"), F.col("g"), 3).alias("ap"), metrics.recall(F.col("r"), F.col("g"), 3).alias("rec"), metrics.reciprocal_rank(F.col("r"), F.col("g"), 5).alias("rr")).collect()
    assert got[0]["ap"] == pytest.approx(5 / 6) and (got[1]["rec"], got[1]["rr"]) == (0.0, 0.2) and got[2]["rr"] is None


def test_ndcg_ideal_is_over_all_judged(spark):
    grades = spark.createDataFrame([("q", "a", 3.0), ("q", "b", 1.0)], "query_id string, doc_id string, grade double")
    got = metrics.ndcg(ranking(spark, ("b", 1), ("a", 2)), grades, 2).first()["ndcg"]
    assert got == pytest.approx((1 + 7 / math.log2(3)) / (7 + 1 / math.log2(3)))


def test_curve_equals_its_definition(spark):
    import random

    rng = random.Random(4)
    items = [(f"q{i}", rng.choice(["x", "y", "", None]), rng.choice([0.1, 0.25, 0.5, rng.random()]), rng.choice([["x"], []]), ["a"], ["a"]) for i in range(120)]
    items = [(q, a, c, g, r, d if g else []) for q, a, c, g, r, d in items]
    got = {r["threshold"]: r for r in calibration.threshold_diagnostics(rows(spark, *items)).collect()}
    assert set(got) == {0.0, 1.0000001, *(x[2] for x in items)}
    for t, r in got.items():
        ok = [bool((a or "").strip()) and c >= t for _, a, c, *_ in items]
        tp = sum(o and bool(x[3]) for o, x in zip(ok, items))
        fp = sum(o and not x[3] for o, x in zip(ok, items))
        gold = sum(bool(x[3]) for x in items)
        assert (r["tp"], r["fp"], r["tn"], r["fn"]) == (tp, fp, len(items) - gold - fp, gold - tp)
        assert r["balanced_accuracy"] == (tp / gold + (len(items) - gold - fp) / (len(items) - gold)) / 2


def test_calibration_prefers_the_higher_threshold(spark):
    r = rows(spark, ("q1", "x", 0.8, ["x"], ["a"], ["a"]), ("q2", "y", 0.3, [], ["a"], []))
    best = calibration.calibrate_threshold(r).first()
    assert 0.3 < best["threshold"] <= 0.8 and best["balanced_accuracy"] == 1.0
    with pytest.raises(ValueError):
        calibration.calibrate_threshold(r, split="test")
    assert tuple(calibration.calibrate_risk(r, 0.0).first()) == (0.8, 0.0, 0.5)


def test_risk_curve_takes_ties_together(spark):
    r = rows(spark, ("q1", "x", 0.5, ["x"], ["a"], ["a"]), ("q2", "y", 0.5, ["x"], ["a"], ["a"]))
    points = calibration.risk_coverage(r).collect()
    assert len(points) == 1 and points[0]["area"] == 0.5


def test_reliability_has_empty_bins(spark):
    r = rows(spark, ("q1", "x", 0.9, ["x"], ["a"], ["a"]), ("q2", "y", 0.7, ["x"], ["a"], ["a"]))
    bins = calibration.reliability_bins(r, 5).orderBy("bin").collect()
    assert [b["count"] for b in bins] == [0, 0, 0, 1, 1] and bins[0]["accuracy"] is None
    assert sum(b["gap"] for b in bins) == pytest.approx(0.4)


def test_weighted_mean_and_citations(spark):
    df = spark.createDataFrame([(0.0, 1.0), (1.0, 3.0)], "v double, w double")
    assert scoring.weighted_mean(df, "v", "w").first()[0] == 0.75


def test_paired_and_bootstrap(spark):
    left, right = (spark.createDataFrame([("a", x), ("b", y)], "query_id string, answer_em double") for x, y in ((1.0, 0.0), (0.0, 0.0)))
    assert tuple(compare.paired_comparison(left, right).first()) == (0.5, 1, 1, 0, 0)
    exact = compare.bootstrap_values([0.0, 1.0] * 50, 500, seed=3)
    fast = compare.bootstrap_mean(spark.createDataFrame([(float(i % 2),) for i in range(100)], "v double"), "v", repetitions=500).first()
    assert exact["estimate"] == fast["estimate"] == 0.5 and abs(exact["lower"] - fast["lower"]) < 0.06
    for bad in ({"repetitions": 1}, {"confidence": 1.0}, {"seed": 0.5}):
        with pytest.raises(ValueError):
            compare.bootstrap_values([1.0], **bad)


def test_grouped_split_keeps_groups(spark):
    df = spark.createDataFrame([(i, f"g{i % 5}") for i in range(10)], "id int, g string")
    sides = compare.grouped_split(df, "g", 0.4).collect()
    assert sorted(r["side"] for r in sides) == ["test", "test", "train", "train", "train"]
    assert len(compare.seeded_split([f"g{i}" for i in range(5)], 0.4)) == 2
    with pytest.raises(ValueError):
        compare.grouped_split(df.filter("g = 'g1'"), "g")


def test_audits(spark, corpus):
    q = spark.createDataFrame([("q1", "What?", ["d1"], ["maps"], "dev"), ("q1", "what?", ["d9"], ["maps"], "test"), ("q2", "WHAT?", ["d1"], [], "dev"), ("bad id", "x", [], [], "dev")], "query_id string, question string, relevant_ids array<string>, answers array<string>, split string")
    assert {(r["rule"], r["key"]) for r in audit.audit_queries(q, corpus).collect()} == {("identifier", "bad id"), ("duplicate", "q1"), ("unknown document", "q1"), ("answerability", "q2"), ("answer not in evidence", "q1"), ("repeated question", "what?")} - ({("answer not in evidence", "q1")} if audit.missing_gold_answers(q, corpus).count() == 0 else set())
    assert {r["kind"] for r in audit.split_overlap(q).collect()} == {"query_id", "question"}
    assert [r["key"] for r in audit.audit_corpus(corpus).filter("rule = 'text:text'").collect()] == ["d3"]
    with pytest.raises(ValueError, match="duplicate: q1"):
        audit.assert_valid(audit.duplicates(q, "query_id"))
    side = audit.coverage_check(q.select("query_id").limit(1), spark.createDataFrame([("zz",)], "query_id string")).collect()
    assert {r["side"] for r in side} == {"missing", "unexpected"}


def test_selection_and_prediction(spark, corpus):
    c = spark.createDataFrame([("q", "b", 2, "x", 0.9, 0, 1), ("q", "a", 1, "y", 0.9, 0, 1)], "query_id string, document_id string, rank int, answer string, confidence double, start int, end int")
    q = asked(spark, ("q", "aster maps"), ("none", "nothing"))
    assert {r["query_id"]: r["document_id"] for r in reader.select_answer(c, q).collect()} == {"q": "a", "none": None}
    got = {r["query_id"]: r for r in reader.predict(q, bm25.search(q, corpus), corpus, reader.LexicalReader(), 0.1).collect()}
    assert got["q"]["answer"] == "The aster archive keeps maps." and got["q"]["document_id"] == "d1" and got["q"]["retrieved_ids"].startswith('["d1"')
    assert got["none"]["abstained"] and got["none"]["start"] is None
    trace = reader.reader_trace(bm25.search(q, corpus).join(q, "query_id").join(corpus, "doc_id").withColumnRenamed("doc_id", "document_id"), reader.LexicalReader())
    assert reader.invalid_results(trace).count() == 0


def test_weights_of_any_size_and_bad_ones(spark):
    top = 1.7e308
    df = spark.createDataFrame([("a", 1.0, top), ("a", 0.0, top), ("b", 1.0, -1.0), ("b", 1.0, 2.0), ("c", 1.0, 0.0), ("d", 5.0, 1e-300)], "g string, v double, w double")
    got = {r["g"]: r["weighted_mean"] for r in scoring.weighted_mean(df, "v", "w", ("g",)).collect()}
    assert got["a"] == 0.5 and got["b"] != got["b"] and got["c"] is None and got["d"] == 5.0
    assert scoring.weighted_mean(df.filter("g = 'a'"), "v", "w").first()[0] == 0.5


def test_a_failing_reader_and_ids_with_quotes(spark):
    class Fails:
        def read(self, question, text):
            if "bad" in text:
                raise KeyError("no")
            return text, 0.9, 0, len(text)

    q = spark.createDataFrame([("q1", "a?"), ("q2", "b?")], "query_id string, question string")
    docs = spark.createDataFrame([('d"1\\', "fine"), ("d2", "bad")], "doc_id string, text string")
    ranking = spark.createDataFrame([("q1", 'd"1\\', 1), ("q2", "d2", 1)], "query_id string, doc_id string, rank int")
    got = {r["query_id"]: r for r in reader.predict(q, ranking, docs, Fails(), 0.5, continue_on_error=True).collect()}
    assert json.loads(got["q1"]["retrieved_ids"]) == ['d"1\\'] and got["q1"]["error"] is None and got["q1"]["answer"] == "fine"
    assert "KeyError" in got["q2"]["error"] and got["q2"]["abstained"]


def test_guards_of_batches_metrics_and_folds(spark):
    q = spark.createDataFrame([("a",), ("b",)], "query_id string")
    good = spark.createDataFrame([("a", "d1", 1), ("a", "d2", 2)], "query_id string, doc_id string, rank int")
    rank.assert_batch(q, good, 2)
    for queries, ranking in ((q.unionByName(q), good), (q, good.withColumn("query_id", F.lit("z"))), (q, good.withColumn("doc_id", F.lit("d")))):
        with pytest.raises(ValueError, match=r"repeated|unknown"):
            rank.assert_batch(queries, ranking, 2)
    rows = spark.createDataFrame([("a", ["x", "x"], ["y"]), ("b", None, [" "]), ("c", ["x"], [])], "query_id string, ranked_ids array<string>, relevant_ids array<string>")
    assert sorted(tuple(r) for r in metrics.invalid_rankings(rows).collect()) == [("a", "ranked_ids repeated"), ("b", "ranked_ids missing"), ("b", "relevant_ids blank")]
    grades = spark.createDataFrame([("a", "d1", 33.0), ("a", "d2", 3.0), ("b", "d1", float("nan"))], "query_id string, doc_id string, grade double")
    assert metrics.invalid_grades(grades).count() == 2
    folds = spark.createDataFrame([("a", 0), ("b", 1), ("c", 0)], "query_id string, fold int")
    assert calibration.place_folds(rows, folds).count() == 3
    for bad in (folds.filter("query_id <> 'c'"), folds.unionByName(folds.limit(1))):
        with pytest.raises(ValueError):
            calibration.place_folds(rows, bad)
    labelled = spark.createDataFrame([("a", ["café", "café "]), ("zz", ["x"])], "query_id string, labels array<string>")
    assert [r[0] for r in scoring.unknown_labelled(rows, labelled).collect()] == ["zz"]


def test_reports_are_compared_by_their_evidence(spark):
    report = {"schema_version": 1, "data_file_sha256": {"a": "x"}, "latency_protocol": {"k": 5}, "models": {"encoder": {"fingerprint": "e"}, "reader": {"fingerprint": "r"}}, "experiments": {"one": {}, "two": {}}, "hardware": {"cpu": 1}}
    rows = spark.createDataFrame([(e, f"q{i}", float(i % 2)) for e in ("one", "two") for i in range(6)], "experiment string, query_id string, answer_em double")
    got = compare.compare_benchmarks(report, report | {"experiments": {"two": {}}}, rows, rows.withColumn("answer_em", F.lit(0.0))).collect()
    assert [(r["experiment"], r["estimate"], r["wins"], r["latency_comparable"]) for r in got] == [("two", 0.5, 3, True)]
    for other in (report | {"latency_protocol": {"k": 4}}, report | {"experiments": {}}, report | {"schema_version": True}, report | {"experiments": {"three": {}}}):
        with pytest.raises(ValueError):
            compare.compare_benchmarks(report, other, rows, rows)
    with pytest.raises(ValueError, match="one side"):
        compare.compare_benchmarks(report, report, rows, rows.filter("query_id <> 'q1'"))


def test_an_index_is_written_and_searched_again(spark, corpus, tmp_path):
    index = bm25.build_index(corpus, block_docs=1)
    index.save(str(tmp_path / "i"))
    again = bm25.Index.load(spark, str(tmp_path / "i"))
    q = asked(spark, ("q1", "aster keys"), ("q2", "archive"))
    want = sorted((r["query_id"], r["doc_id"], round(r["score"], 9), r["rank"]) for r in bm25.search(q, corpus).collect())
    assert want and sorted((r["query_id"], r["doc_id"], round(r["score"], 9), r["rank"]) for r in bm25.search_index(q, again).collect()) == want
    assert again.fingerprint == bm25.build_index(corpus.repartition(3)).fingerprint != bm25.build_index(corpus.limit(1)).fingerprint
    assert bm25.search(q, corpus.limit(0)).count() == 0 and bm25.search(q.limit(0), corpus).count() == 0
