import json
import zipfile

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from querent import cli
from querent.sources import artifacts, jsonl
from querent.streaming.requests import answer_stream

CORPUS = [{"doc_id": "d1", "title": "Aster", "text": "The aster archive keeps maps."}, {"doc_id": "d2", "title": "Cedar", "text": "The cedar archive keeps keys for two years."}]


def lines(path, items):
    path.write_text("".join((x if isinstance(x, str) else json.dumps(x)) + "\n" for x in items), encoding="utf-8")
    return str(path)


def query(i, doc, answer, text):
    return {"query_id": i, "question": text, "relevant_ids": [doc] if doc else [], "answers": [answer] if answer else []}


@pytest.fixture
def data(tmp_path):
    folder = tmp_path / "data"
    folder.mkdir()
    lines(folder / "corpus.jsonl", CORPUS)
    lines(folder / "dev.jsonl", [query("v1", "d1", "maps", "What does the aster archive keep?"), query("v2", None, None, "Who paints ships?")])
    lines(folder / "test.jsonl", [query("t1", "d2", "keys", "What does cedar hold?"), query("t2", None, None, "Which colour is it?")])
    return folder


@pytest.mark.parametrize(("bad", "message"), [('{"doc_id":"a","doc_id":"b"}', "duplicate JSON field"), ('{"a":NaN}', "nonstandard"), ("[1]", "objects"), ('{"doc_id":"a"}', "fields"), ('{"doc_id":1,"title":"t","text":"x"}', "wrong type"), ("{", "malformed")])
def test_strict_lines_name_the_line(spark, tmp_path, bad, message):
    path = lines(tmp_path / "c.jsonl", [CORPUS[0], "", bad])
    with pytest.raises(ValueError, match=rf"c\.jsonl:3: .*{message}"):
        jsonl.scan_corpus(spark, path)


def test_budgets_and_empty_files(spark, tmp_path):
    path = lines(tmp_path / "c.jsonl", CORPUS)
    for kw in ({"max_bytes": 20}, {"max_records": 1}):
        with pytest.raises(ValueError, match="budget"):
            jsonl.scan_jsonl(spark, path, jsonl.CORPUS, **kw)
    with pytest.raises(ValueError, match="at least one"):
        jsonl.scan_jsonl(spark, lines(tmp_path / "e.jsonl", ["", " "]), jsonl.CORPUS)


def test_scans_validate(spark, tmp_path, data):
    docs = jsonl.scan_corpus(spark, str(data / "corpus.jsonl"))
    assert jsonl.scan_queries(spark, str(data / "dev.jsonl"), docs).count() == 2
    with pytest.raises(ValueError, match="unknown document"):
        jsonl.scan_queries(spark, lines(tmp_path / "q.jsonl", [query("a", "zz", "maps", "Q?")]), docs)
    with pytest.raises(ValueError, match="duplicate"):
        jsonl.scan_corpus(spark, lines(tmp_path / "d.jsonl", [CORPUS[0], CORPUS[0]]))


def test_calibration_envelope(tmp_path):
    own = artifacts.bind_calibration({"split": "dev", "threshold": 0.5}, "a" * 64, "b" * 64)
    path = tmp_path / "c.json"
    artifacts.save_calibration(path, own)
    assert artifacts.load_calibration(path) == own and artifacts.verify_binding(own, "a" * 64, "b" * 64) == 0.5
    with pytest.raises(FileExistsError):
        artifacts.save_calibration(path, own)
    path.write_text(path.read_text().replace("0.5", "0.6"))
    with pytest.raises(ValueError, match="checksum"):
        artifacts.load_calibration(path)
    with pytest.raises(ValueError, match="other data"):
        artifacts.verify_binding(own, "c" * 64, "b" * 64)


def test_bundles_round_trip_and_refuse_tampering(spark, tmp_path):
    docs = spark.createDataFrame([tuple(x.values()) for x in CORPUS], "doc_id string, title string, text string")
    vectors = spark.createDataFrame([("d1", [1.0]), ("d2", [1.0])], "doc_id string, embedding array<float>")
    artifacts.save_bundle(tmp_path / "b", docs, vectors, {"schema_version": 2, "corpus": "a" * 64, "encoder": "b" * 64})
    artifacts.export_bundle(tmp_path / "b", tmp_path / "b.zip")
    artifacts.import_bundle(tmp_path / "b.zip", tmp_path / "c")
    again, _, _ = artifacts.load_bundle(spark, tmp_path / "c")
    assert artifacts.parity(again, docs)
    (tmp_path / "c" / "extra").write_text("x")
    with pytest.raises(ValueError, match="do not match"):
        artifacts.inspect_bundle(tmp_path / "c")
    for name in ("../x", "/x", "a\\b"):
        with zipfile.ZipFile(tmp_path / "bad.zip", "w") as z:
            z.writestr(name, "x")
        with pytest.raises(ValueError, match="unsafe"):
            artifacts.import_bundle(tmp_path / "bad.zip", tmp_path / "bad")
        assert not (tmp_path / "bad").exists()


def test_run_config_and_status(tmp_path):
    with pytest.raises(ValueError):
        artifacts.RunConfig("a", "b", 3, 5)
    with pytest.raises(RuntimeError), artifacts.run_status(tmp_path / "r"):
        artifacts.set_stage(tmp_path / "r", "score")
        raise RuntimeError("no")
    assert json.loads((tmp_path / "r" / "status.json").read_text())["stage"] == "score"


def test_command_line(spark, data, tmp_path, capsys):
    facts = cli.audit_data(spark, str(data))
    assert (facts["documents"], facts["dev"], facts["test"]) == (2, 2, 2)
    report = cli.run(spark, artifacts.RunConfig(str(data), str(tmp_path / "out")))
    assert report["metrics"]["test"]["query_count"] == 2 and report["metrics"]["test"]["recall_at_1"] == 1.0
    assert cli.main(["inspect", str(tmp_path / "missing")]) == 2


def test_predictions_keep_order_and_never_overwrite(spark, tmp_path):
    df = spark.createDataFrame([(2, "b", "x", None), (1, "a", None, "ValueError")], "_ord int, query_id string, answer string, error string")
    out = str(tmp_path / "p")
    assert jsonl.sink_predictions(df, out) == {"succeeded": 1, "failed": 1}
    assert [json.loads(r["value"])["query_id"] for r in spark.read.text(out).collect()] == ["a", "b"]
    with pytest.raises(Exception, match="(?i)already exists"):
        jsonl.sink_predictions(df, out)


def test_cache_releases_the_oldest(spark):
    cache, made = artifacts.RankingCache(1), []
    make = lambda: made.append(1) or spark.range(1)
    cache.get("f", "q", 5, make)
    cache.get("f", "q", 5, make)
    cache.get("f", "r", 5, make)
    assert len(made) == 2 and list(cache.held) == [("f", "r", 5)]


def test_request_stream(spark, tmp_path, data):
    src = tmp_path / "in"
    src.mkdir()
    lines(src / "a.json", [{"query_id": "r1", "question": "aster"}, {"query_id": "bad id", "question": "aster"}])
    docs = jsonl.scan_corpus(spark, str(data / "corpus.jsonl"))
    answer_stream(spark, str(src), str(tmp_path / "out"), str(tmp_path / "ck"), docs).awaitTermination()
    got = {r["query_id"]: r["n"] for r in spark.read.parquet(str(tmp_path / "out")).select("query_id", F.coalesce(F.size("ranked"), F.lit(0)).alias("n")).collect()}
    assert got["r1"] == 1 and got["bad id"] <= 0


def test_contracts_tell_every_broken_rule():
    counts = {"documents": 1, "development_queries": 1, "held_out_queries": 2}
    own = {"kind": "k", "license": "l", "permission": "p", "counts": counts}
    artifacts.valid_provenance(own, counts)
    for bad in (own | {"counts": counts | {"documents": True}}, own | {"license": " "}, own | {"counts": counts | {"documents": 2}}, [], None):
        with pytest.raises(ValueError):
            artifacts.valid_provenance(bad, counts)
    from querent.sources.contracts import faults

    assert len(faults("calibration", {"schema_version": True})) == 5


def test_changed_gold_answers_change_the_development_fingerprint(spark):
    schema = "query_id string, raw_answer string, confidence double, answers array<string>, ranked_ids array<string>, relevant_ids array<string>"
    rows = [("a", "x", 0.5, ["x"], ["d1"], ["d1"]), ("b", "", 0.1, [], ["d2"], [])]
    prints = [artifacts.development_fingerprint(spark.createDataFrame(r, schema)) for r in (rows, rows[::-1], [("a", "x", 0.5, ["y"], ["d1"], ["d1"]), rows[1]])]
    assert prints[0] == prints[1] != prints[2]


@pytest.mark.parametrize("names", [("a/../b",), ("a", "a"), ("a", "a/b"), ("a:b",), ("./a",)])
def test_archives_with_unsafe_or_colliding_names(tmp_path, names):
    with zipfile.ZipFile(tmp_path / "bad.zip", "w") as z:
        for n in names:
            z.writestr(n, "x")
    with pytest.raises(ValueError, match=r"unsafe|twice|at once"):
        artifacts.import_bundle(tmp_path / "bad.zip", tmp_path / "out")
    assert not (tmp_path / "out").exists()


def test_runs_are_compared(spark, data, tmp_path, capsys):
    report = cli.run(spark, artifacts.RunConfig(str(data), str(tmp_path / "a"), samples=50))
    assert set(report["experiments"]) == {"lexical", "dense", "fused"}
    assert cli.main(["compare", str(tmp_path / "a"), str(tmp_path / "a")]) == 0
    got = json.loads(capsys.readouterr().out.strip().splitlines()[-1])
    assert [(r["experiment"], r["estimate"], r["ties"], r["latency_comparable"]) for r in got] == [(e, 0.0, 2, True) for e in ("dense", "fused", "lexical")]
    lines = [json.loads(x)["stage"] for x in (tmp_path / "a" / "log.jsonl").read_text().splitlines()]
    assert lines == ["running", "index", "predict", "score", "complete"]


def test_matrices_are_told_by_their_header(spark, tmp_path):
    from querent.sources.npy import npy_facts, read_npy

    x = np.arange(12, dtype=np.float32).reshape(4, 3)
    np.save(tmp_path / "x.npy", x)
    facts = npy_facts(tmp_path / "x.npy", 4, 3)
    assert (facts.rows, facts.dimension) == (4, 3)
    assert [r["embedding"] for r in read_npy(spark, str(tmp_path / "x.npy")).orderBy("row").collect()] == x.tolist()
    np.save(tmp_path / "f.npy", np.asfortranarray(x))
    np.save(tmp_path / "i.npy", x.astype(int))
    np.save(tmp_path / "v.npy", x.ravel())
    (tmp_path / "t.npy").write_bytes((tmp_path / "x.npy").read_bytes()[:-1])
    (tmp_path / "n.npy").write_bytes(b"no")
    for bad in ("f", "i", "v", "t", "n"):
        with pytest.raises(ValueError):
            npy_facts(tmp_path / f"{bad}.npy")
    for wrong in ({"rows": 5}, {"dimension": 2}, {"max_bytes": 8}):
        with pytest.raises(ValueError):
            npy_facts(tmp_path / "x.npy", **wrong)


def test_models_are_copied_by_their_inventory(tmp_path):
    (tmp_path / "m" / "sub").mkdir(parents=True)
    (tmp_path / "m" / "sub" / "w.bin").write_bytes(b"1")
    own = artifacts.model_inventory(tmp_path / "m")
    artifacts.copy_verified_model(tmp_path / "m", tmp_path / "c", own)
    assert artifacts.model_inventory(tmp_path / "c") == own
    (tmp_path / "m" / "extra").write_bytes(b"2")
    with pytest.raises(ValueError):
        artifacts.copy_verified_model(tmp_path / "m", tmp_path / "d", own)
    assert not (tmp_path / "d").exists()


def test_small_frames_keep_their_index(spark):
    from querent.operators import reader
    from querent.plans.session import cpu_threads

    def answer(rows):
        return rows.select("query_id", F.col("question").alias("answer"), F.lit(0.5).alias("confidence"), F.lit(False).alias("abstained"), F.lit(None).cast("string").alias("document_id"), F.lit(None).cast("int").alias("start"), F.lit(None).cast("int").alias("end"), F.lit("[]").alias("retrieved_ids"))

    got = reader.predict_questions(spark, pd.DataFrame({"question": ["b", "a", "b"]}, index=[7, 7, 3]), answer)
    assert list(got.index) == [7, 7, 3] and list(got["answer"]) == ["b", "a", "b"] and list(got.columns) == [f.name for f in reader.PREDICTION.fields][1:]
    with pytest.raises(ValueError):
        reader.predict_questions(spark, pd.DataFrame({"q": []}), answer)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    with cpu_threads(spark, 3):
        assert spark.conf.get("spark.sql.shuffle.partitions") == "3"
    assert spark.conf.get("spark.sql.shuffle.partitions") == before
    with pytest.raises(ValueError), cpu_threads(spark, 0):
        pass
