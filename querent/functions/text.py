"""Scalar functions on text, answers and vectors as column expressions.

Everything here stays in the JVM except what needs Unicode normalization or case folding, which
Spark has no function for: those are Arrow UDFs.
"""

from __future__ import annotations

import hashlib
import json
import re
import string
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# White space as Python's str.strip sees it, the identifier grammar, word characters.
SPACE = r"[\s\x1c-\x1f]"
IDENTIFIER = r"\A[A-Za-z0-9][A-Za-z0-9._:-]{0,127}\z"
WORD = r"[\p{L}\p{N}_]+"
PUNCTUATION = r"[!-/:-@\[-`{-~]"
TEXT_LIMIT, QUESTION_LIMIT = 10_000, 2_048


def is_blank(c: Column) -> Column:
    return ~c.rlike(rf"(?U)[^\s\x1c-\x1f]")


def has_answer(c: Column) -> Column:
    """A string that isn't blank; null is no answer."""
    return F.coalesce(~is_blank(c), F.lit(False))


def valid_identifier(c: Column) -> Column:
    return F.coalesce(c.rlike(IDENTIFIER), F.lit(False))


def valid_text(c: Column, limit: int = TEXT_LIMIT) -> Column:
    return F.coalesce(~is_blank(c) & (F.length(c) <= limit), F.lit(False))


def valid_request(question: Column) -> Column:
    return valid_text(question, QUESTION_LIMIT)


def check_k(k: object) -> int:
    """A result count from 1 to 100; booleans are no counts."""
    if type(k) is not int or not 1 <= k <= 100:
        raise ValueError("k must be an integer from 1 to 100")
    return k


def tokens(c: Column) -> Column:
    """Runs of letters, digits and underscores of the lower-cased text."""
    return F.regexp_extract_all(F.lower(c), F.lit(f"({WORD})"), 1)


def tokens_configured(normal_form: str = "NFKC", min_length: int = 1):
    """A UDF: normal form, case folding, words of at least ``min_length``; lone surrogates are an error."""
    if normal_form not in ("NFC", "NFKC") or type(min_length) is not int or min_length < 1:
        raise ValueError("normal_form must be NFC or NFKC and min_length at least 1")

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def split(s: pd.Series) -> pd.Series:
        word = re.compile(r"\w+")
        return s.map(lambda x: None if x is None else [w for w in word.findall(unicodedata.normalize(normal_form, x).casefold()) if len(w) >= min_length])

    return split


@F.pandas_udf(T.StringType())
def question_key(s: pd.Series) -> pd.Series:
    """NFKC, case-folded, white space collapsed: equal keys are the same question."""
    return s.map(lambda x: None if x is None else " ".join(unicodedata.normalize("NFKC", x).casefold().split()))


def ascii_key(c: Column) -> Column:
    """The question key of texts whose case folding is lower-casing, without leaving the JVM."""
    return F.trim(F.regexp_replace(F.lower(c), rf"(?U){SPACE}+", " "))


def normalize_squad(c: Column) -> Column:
    """Lower case, ASCII punctuation deleted, articles dropped, white space collapsed."""
    bare = F.regexp_replace(F.lower(c), PUNCTUATION, "")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, r"(?U)\b(a|an|the)\b", " "), rf"(?U){SPACE}+", " "))


@F.pandas_udf(T.StringType())
def composed(s: pd.Series) -> pd.Series:
    """The canonical composition (NFC) of a text, which makes spellings of one label equal."""
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFC", x))


@F.pandas_udf(T.StringType())
def normalize_unicode(s: pd.Series) -> pd.Series:
    """As ``normalize_squad`` after NFKC and case folding, with all Unicode punctuation deleted."""
    article, drop = re.compile(r"\b(a|an|the)\b"), str.maketrans("", "", string.punctuation)

    def one(x: str | None) -> str | None:
        if x is None:
            return None
        x = unicodedata.normalize("NFKC", x).casefold()
        x = "".join(ch for ch in x if unicodedata.category(ch)[0] != "P").translate(drop)
        return " ".join(article.sub(" ", x).split())

    return s.map(one)


def answer_tokens(c: Column) -> Column:
    return F.filter(F.split(normalize_squad(F.coalesce(c, F.lit(""))), " "), lambda x: x != "")


def gold_tokens(answers: Column) -> Column:
    """Token lists of the gold answers; no gold answers stand for one empty answer."""
    golds = F.when(F.coalesce(F.size(answers), F.lit(0)) < 1, F.array(F.lit(""))).otherwise(answers)
    return F.transform(golds, answer_tokens)


def answer_em(answer: Column, answers: Column) -> Column:
    """1 if the answer's tokens equal those of some gold answer."""
    own = answer_tokens(answer)
    return F.array_max(F.transform(gold_tokens(answers), lambda g: (g == own).cast("double")))


def _token_f1(p: Column, g: Column) -> Column:
    times = lambda xs, t: F.size(F.filter(xs, lambda x: x == t))
    common = F.aggregate(F.array_distinct(p), F.lit(0), lambda n, t: n + F.least(times(p, t), times(g, t)))
    total = F.size(p) + F.size(g)
    return F.when(total == 0, 1.0).otherwise(F.coalesce(F.try_divide(2.0 * common, total), F.lit(0.0)))


def answer_f1(answer: Column, answers: Column) -> Column:
    """The largest multiset-overlap F1 of tokens over the gold answers."""
    own = answer_tokens(answer)
    return F.array_max(F.transform(gold_tokens(answers), lambda g: _token_f1(own, g)))


def _occurrences(text: str | None, answer: str | None) -> list[dict]:
    out, at = [], text.find(answer) if text and answer else -1
    while at >= 0:
        out.append({"start": at, "end": at + len(answer)})
        at = text.find(answer, at + 1)
    return out


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])))
def _answer_spans(text: pd.Series, answer: pd.Series) -> pd.Series:
    return pd.Series([_occurrences(t, a) for t, a in zip(text, answer)])


def answer_spans(text: Column, answer: Column) -> Column:
    """(start, end) of every literal occurrence, overlapping ones included; none of a null or empty answer, or in a null text."""
    return _answer_spans(text, answer)


def valid_span(text: Column, answer: Column, start: Column, end: Column) -> Column:
    return F.coalesce((start >= 0) & (start < end) & (end <= F.length(text)) & (F.substring(text, start + 1, end - start) == answer), F.lit(False))


def idf(n: Column, df: Column) -> Column:
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def bm25_term(weight: Column, tf: Column, length: Column, mean: Column, k1: float, b: float) -> Column:
    return weight * tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / mean))


def discount(grade: Column, rank: Column) -> Column:
    """Gain of a grade at a 1-based rank."""
    return (F.pow(F.lit(2.0), grade) - 1) / F.log2(rank + 1)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, also where a lambda inside asks for it at every element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def scaled_unit(v: Column) -> Column:
    """The unit vector, by the largest magnitude first, so that 1e300 and 1e-300 survive; null for a zero vector."""
    norm = lambda x: F.sqrt(F.aggregate(x, F.lit(0.0), lambda s, y: s + y * y))
    top = lambda d: F.array_max(F.transform(d, F.abs))
    unit = lambda x: let(norm(x), lambda n: F.transform(x, lambda y: F.try_divide(y, n)))
    scaled = lambda d: let(top(d), lambda t: F.when(t > 0, unit(F.transform(d, lambda x: F.try_divide(x, t)))))
    return let(F.transform(v, lambda x: x.cast("double")), scaled)


def finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))


def bin_index(confidence: Column, bins: int) -> Column:
    return F.least(F.lit(bins - 1), F.floor(confidence * bins).cast("int"))


def json_nulls(c: Column) -> Column:
    return F.nanvl(c.cast("double"), F.lit(None).cast("double"))


def canonical_hash(value: object) -> str:
    """SHA-256 of canonical JSON: sorted keys, no blanks, ASCII escapes; NaN and infinities are errors."""
    return hashlib.sha256(json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=True, allow_nan=False).encode()).hexdigest()


def row_hash(names: list[str]):
    """A UDF of the canonical hash of rows with these fields."""

    @F.pandas_udf(T.StringType())
    def run(s: pd.DataFrame) -> pd.Series:
        def plain(v: object) -> object:
            return v.tolist() if hasattr(v, "tolist") else v

        return pd.Series([canonical_hash({n: plain(v) for n, v in zip(names, row)}) for row in s[names].itertuples(index=False, name=None)])

    return run


def model_identity(fingerprint: Column) -> Column:
    return F.concat(F.lit("local:sha256:"), fingerprint)


def truncate_audit(text: Column, max_tokens: int) -> Column:
    """(tokens, truncated, retained_end): what is left of a text under a token limit, by words."""
    pattern = rf"(?:[^\p{{L}}\p{{N}}_]*{WORD}){{0,{max_tokens}}}"
    count = F.size(tokens(text))
    return F.struct(count.alias("tokens"), (count > max_tokens).alias("truncated"), F.when(count > max_tokens, F.length(F.regexp_extract(text, rf"\A({pattern})", 1))).otherwise(F.length(text)).alias("retained_end"))
