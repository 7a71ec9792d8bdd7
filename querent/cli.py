"""Command line: audit, run, predict, compare, inspect, export, import."""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from pyspark.sql import functions as F

from querent.operators import audit, bm25, calibration, compare, dense, rank, reader, scoring
from querent.plans.session import local_session
from querent.sources import artifacts, jsonl


def audit_data(spark, folder: str) -> dict:
    """Counts, fingerprints and isolation of corpus.jsonl, dev.jsonl and test.jsonl."""
    corpus = jsonl.scan_corpus(spark, f"{folder}/corpus.jsonl")
    splits = {s: jsonl.scan_queries(spark, f"{folder}/{s}.jsonl", corpus).withColumn("split", F.lit(s)) for s in ("dev", "test")}
    both = splits["dev"].unionByName(splits["test"])
    shared = audit.split_policy(both, corpus).count()
    if shared:
        raise ValueError(f"{shared} ids, questions or documents stand in both splits")
    paths = {n: f"{folder}/{n}.jsonl" for n in ("corpus", "dev", "test")}
    return {"documents": corpus.count(), **{s: q.count() for s, q in splits.items()}, "corpus_sha256": artifacts.corpus_hash(corpus, "_ord"), "manifest": artifacts.dataset_manifest(spark, paths)}


def rankings(questions, corpus, index, vectors, encoder, k: int) -> dict:
    """The ranking of each experiment: lexical, dense, and both fused."""
    lexical = bm25.search_index(questions, index, k)
    near = dense.search(dense.encode_questions(questions, encoder), vectors, k, encoder.dimension)
    return {"lexical": lexical, "dense": near, "fused": rank.reciprocal_rank_fusion([lexical, near], k=k)}


def evaluate(questions, corpus, ranking, config: artifacts.RunConfig):
    """Evaluation rows of a ranking and the lexical reader."""
    rank.assert_batch(questions, ranking, config.retrieval_k)
    lists = rank.retrieve_batch(questions, ranking).select("query_id", F.transform("ranked", lambda x: x["doc_id"]).alias("ranked_ids"))
    got = reader.predict(questions, ranking, corpus, reader.LexicalReader(), 0.0, config.reader_k).select("query_id", F.col("answer").alias("raw_answer"), "confidence", "document_id")
    return questions.select("query_id", "split", "answers", "relevant_ids").join(lists, "query_id").join(got, "query_id")


def run(spark, config: artifacts.RunConfig) -> dict:
    """Audits, builds the indexes once, predicts, freezes each threshold on the development split, scores both splits, writes the evidence."""
    encoder = dense.HashedEncoder()
    with artifacts.run_status(config.output):
        facts = audit_data(spark, config.data)
        artifacts.set_stage(config.output, "index")
        corpus = jsonl.scan_corpus(spark, f"{config.data}/corpus.jsonl")
        index = bm25.build_index(corpus)
        artifacts.save_bundle(f"{config.output}/bundle", corpus, dense.encode_corpus(corpus, encoder), {"schema_version": 2, "corpus": facts["corpus_sha256"], "encoder": encoder.fingerprint, "lexical_index": index.fingerprint, "reader_k": config.reader_k})
        _, vectors, manifest = artifacts.load_bundle(spark, f"{config.output}/bundle")
        artifacts.valid_index(manifest, facts["corpus_sha256"], encoder.fingerprint)
        artifacts.set_stage(config.output, "predict")
        # the splits share no id, as the audit found, so one search answers both
        splits = {s: jsonl.scan_queries(spark, f"{config.data}/{s}.jsonl", corpus).withColumn("split", F.lit(s)) for s in ("dev", "test")}
        asked = splits["dev"].unionByName(splits["test"])
        ranked = rankings(asked, corpus, index, vectors, encoder, config.retrieval_k)
        rows = {name: evaluate(asked, corpus, ranking, config).persist() for name, ranking in ranked.items()}
        artifacts.set_stage(config.output, "score")
        report = {
            "schema_version": 1, "data_audit": facts, "data_file_sha256": facts["manifest"]["files"], "protocol": config.protocol, "latency_protocol": config.protocol, "execution": artifacts.execution_info(spark),
            "hardware": artifacts.machine_info(), "models": {"encoder": {"fingerprint": encoder.fingerprint}, "reader": {"fingerprint": artifacts.canonical_hash("lexical reader 1")}}, "experiments": {},
        }
        for name, own in rows.items():
            dev = own.filter("split = 'dev'")
            calibration.assert_support(dev)
            best = calibration.calibrate_threshold(dev).first()
            frozen = {"split": "dev", "threshold": best["threshold"], "objective_value": best["balanced_accuracy"]}
            bound = artifacts.bind_calibration(frozen, facts["manifest"]["sha256"], artifacts.development_fingerprint(dev))
            artifacts.save_calibration(f"{config.output}/calibration-{name}.json", bound)
            scored = scoring.scored(own, best["threshold"], config.reader_k)
            scored.write.partitionBy("split").parquet(f"{config.output}/rows/experiment={name}")
            metrics = {r["split"]: r.asDict() for r in scored.groupBy("split").agg(*scoring.metric_aggregates(config.cutoffs)).collect()}
            spread = {r["split"]: r.asDict() for r in compare.bootstrap_mean(scored, "answer_em", ("split",), max(2, config.samples), seed=config.seed).collect()}
            report["experiments"][name] = {"calibration": frozen, "metrics": metrics, "answer_em": spread}
            own.unpersist()
        report |= {"metrics": report["experiments"]["lexical"]["metrics"], "calibration": report["experiments"]["lexical"]["calibration"]}
        Path(config.output, "report.json").write_text(json.dumps(report, indent=2, allow_nan=False) + "\n", encoding="utf-8")
    return report


def compare_runs(spark, left: str, right: str) -> list[dict]:
    """The paired differences of the test rows of two runs, experiment by experiment."""
    reports = [jsonl.strict_loads(Path(x, "report.json").read_text(encoding="utf-8")) for x in (left, right)]
    rows = [spark.read.parquet(f"{x}/rows").filter("split = 'test'") for x in (left, right)]
    return [r.asDict() for r in compare.compare_benchmarks(*reports, *rows).collect()]


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="querent", description=__doc__)
    sub = parser.add_subparsers(dest="command", required=True)
    sub.add_parser("audit").add_argument("data")
    p = sub.add_parser("run")
    p.add_argument("data")
    p.add_argument("output")
    p.add_argument("--retrieval-k", type=int, default=5)
    p.add_argument("--reader-k", type=int, default=3)
    p = sub.add_parser("predict")
    p.add_argument("data")
    p.add_argument("requests")
    p.add_argument("output")
    p.add_argument("--threshold", type=float, default=0.0)
    p.add_argument("--continue-on-error", action="store_true")
    p = sub.add_parser("compare")
    p.add_argument("left")
    p.add_argument("right")
    sub.add_parser("inspect").add_argument("bundle")
    for name in ("export", "import"):
        p = sub.add_parser(name)
        p.add_argument("source")
        p.add_argument("target")
    args = parser.parse_args(argv)
    try:
        if args.command == "inspect":
            out = artifacts.inspect_bundle(args.bundle)
        elif args.command == "export":
            out = artifacts.export_bundle(args.source, args.target)
        elif args.command == "import":
            out = artifacts.import_bundle(args.source, args.target)
        else:
            spark = local_session()
            if args.command == "compare":
                out = compare_runs(spark, args.left, args.right)
            elif args.command == "audit":
                out = audit_data(spark, args.data)
            elif args.command == "run":
                out = run(spark, artifacts.RunConfig(args.data, args.output, args.retrieval_k, args.reader_k))
            else:
                corpus, asked = jsonl.scan_corpus(spark, f"{args.data}/corpus.jsonl"), jsonl.scan_requests(spark, args.requests)
                ranking = bm25.search(asked, corpus, 5)
                got = reader.predict(asked, ranking, corpus, reader.LexicalReader(), args.threshold, continue_on_error=args.continue_on_error)
                got = got if args.continue_on_error else got.withColumn("error", F.lit(None).cast("string"))
                out = jsonl.sink_predictions(got.join(asked.select("query_id", "_ord"), "query_id"), args.output)
    except (ValueError, OSError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 2
    print(json.dumps(out, default=str))
    return 0


if __name__ == "__main__":
    sys.exit(main())
