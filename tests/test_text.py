import hashlib

import pytest
from pyspark.sql import functions as F

from querent.functions import text as X


def one(spark, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'array<string>' if isinstance(v, list) else 'string'}" for k, v in values.items()))


def value(df, column):
    return df.select(column.alias("x")).first()["x"]


def test_tokens_keep_accents_and_split_on_marks(spark):
    assert value(one(spark, t="Café naïve_1, 東京!"), X.tokens(F.col("t"))) == ["café", "naïve_1", "東京"]


@pytest.mark.parametrize(("answer", "golds", "em", "f1"), [("red red", ["red blue"], 0.0, 0.5), ("", [], 1.0, 1.0), ("extra", [], 0.0, 0.0), ("The seven-years!", ["sevenyears"], 1.0, 1.0), ("b", ["a b c d", "b"], 1.0, 1.0)])
def test_answer_scores(spark, answer, golds, em, f1):
    row = one(spark, a=answer, g=golds).select(X.answer_em(F.col("a"), F.col("g")).alias("em"), X.answer_f1(F.col("a"), F.col("g")).alias("f1")).first()
    assert (row["em"], row["f1"]) == (em, f1)


def test_spans_overlap(spark):
    assert [tuple(x) for x in value(one(spark, t="ééé", a="éé"), X.answer_spans(F.col("t"), F.col("a")))] == [(0, 2), (1, 3)]
    assert value(one(spark, t="a", a="abc"), X.answer_spans(F.col("t"), F.col("a"))) == []


@pytest.mark.parametrize(("name", "ok"), [("a.b:c-1", True), (" a", False), ("a\n", False), ("../a", False), ("a" * 129, False), ("a" * 128, True)])
def test_identifiers(spark, name, ok):
    assert value(one(spark, t=name), X.valid_identifier(F.col("t"))) is ok


def test_blank_as_python_sees_it(spark):
    assert value(one(spark, t="\t\x1c　"), X.is_blank(F.col("t"))) is True
    assert value(one(spark, t="x" * 10_001), X.valid_text(F.col("t"))) is False


def test_question_key_folds(spark):
    assert value(one(spark, t="  Straße  ＡＢ "), X.question_key("t")) == "strasse ab"


def test_canonical_hash_is_ascii_json():
    assert X.canonical_hash({"b": 1, "a": "é"}) == hashlib.sha256(b'{"a":"\\u00e9","b":1}').hexdigest()
    with pytest.raises(ValueError):
        X.canonical_hash({"a": float("nan")})


def test_extreme_vectors_keep_their_direction(spark):
    df = spark.createDataFrame([([3e300, 4e300],), ([3e-300, 4e-300],), ([0.0, 0.0],)], "v array<double>")
    got = [r["u"] for r in df.select(X.scaled_unit(F.col("v")).alias("u")).collect()]
    assert got[0] == pytest.approx([0.6, 0.8]) and got[1] == pytest.approx([0.6, 0.8]) and got[2] is None


def test_k_is_a_count():
    for bad in (0, 101, True, 2.0):
        with pytest.raises(ValueError):
            X.check_k(bad)
