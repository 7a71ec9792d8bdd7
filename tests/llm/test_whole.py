"""Operators of this subpackage on small fixtures."""

from datetime import datetime

import numpy as np
import pytest

from querent.llm import neighbours, overlaps

QUERIES = "query_id string, question string, relevant_ids array<string>, answers array<string>, split string, source string, created_at timestamp"


def ask(query_id, question, split, relevant=(), answers=()):
    return query_id, question, list(relevant), list(answers), split, "s", datetime(2026, 1, 1)


def test_copies_do_not_end_the_rounds_early(spark):
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((12, 16)) * 2
    x = (centres[rng.integers(0, 12, 600)] + rng.standard_normal((600, 16))).astype(np.float32).tolist()
    rows = [(i + 1, v) for i, v in enumerate(x)]
    build = lambda rows: neighbours.build_graph(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), dims=16, block_rows=100, home_rows=150, orders=2)
    # nine tenths of the rows are copies, the graph is the same
    assert build(rows + [(600 * c + i, v) for c in range(1, 10) for i, v in rows]).rounds == pytest.approx(build(rows).rounds)


def test_report_tells_the_same_text_from_the_same_words(spark):
    rows = [ask("a", "Café one two", "train"), ask("b", "two one cafe", "test"), ask("c", "cafe ONE, two!", "test"), ask("d", "cafe one two two", "test")]
    got = overlaps.overlap_report(spark.createDataFrame(rows, QUERIES)).first()
    assert (got["records"], got["exact"], got["identical"]) == (3, 3, 1)
