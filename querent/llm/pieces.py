"""Splitting oversized items at natural boundaries, by recursive bisection."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT, OVERLAP = 512, 64

# The boundary characters, after which a text may be cut.
BOUNDARY_CHARS = " \t\n\r　。！？"
_BLANKS = " \t\n\r　"


def _strengths(text: str) -> np.ndarray:
    """The strength of a cut before each code point: 0 none, 1 blank, 2 after a comma, 3 after a sentence, 4 line, 5 paragraph."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    before = np.zeros(len(codes), np.int8)
    if len(codes) < 2:
        return before
    one = np.isin(codes, [ord(c) for c in BOUNDARY_CHARS])
    newline = (codes == 10) | (codes == 13)
    blank = np.isin(codes, [ord(c) for c in _BLANKS])
    prev, prev2 = codes[:-1], np.r_[np.uint32(0), codes[:-2]]
    before[1:] = one[:-1]
    after_blank = blank[:-1]
    before[1:][after_blank & np.isin(prev2, [ord(c) for c in ",;:、，；"])] = 2
    ends = np.isin(prev2, [ord(c) for c in ".!?…。！？।؟"])
    before[1:][(after_blank & ends) | (one[:-1] & ~after_blank)] = 3
    before[1:][newline[:-1]] = 4
    double = newline[:-1] & np.r_[False, newline[:-2]] & ~((prev == 10) & (prev2 == 13))
    quad = np.zeros(len(codes) - 1, bool)
    if len(codes) > 4:
        quad[3:] = (codes[3:-1] == 10) & (codes[2:-2] == 13) & (codes[1:-3] == 10)
    before[1:][double | quad] = 5
    # a cut inside a run of blanks would leave blanks at the start of a piece
    inside = np.r_[blank[1:], False][: len(codes) - 1] if len(codes) > 1 else blank[:0]
    before[1:][inside & after_blank] = 0
    return before


def _hard(text: str, at: int, low: int) -> int:
    """A cut where there is no boundary: not inside a character with its marks or joiners."""
    cut = at
    while cut > low + 1 and at - cut < 32 and (unicodedata.category(text[cut])[0] == "M" or text[cut] in "‍️" or text[cut - 1] == "‍"):
        cut -= 1
    return cut if cut > low + 1 else at


def _bisect(text: str, strength: np.ndarray, core: int) -> tuple[list[int], list[tuple[int, int]]]:
    """Cuts of a text into parts of at most ``core``, and the parts without any boundary that had to be cut hard."""
    where = np.flatnonzero(strength)
    cuts, unbroken, todo = [], [], [(0, len(text))]
    while todo:
        a, b = todo.pop()
        if b - a <= core:
            continue
        lo, hi = np.searchsorted(where, [a + 1, b])
        mid = (a + b) // 2
        if lo == hi:
            unbroken.append((a, b))
            parts = -(-(b - a) // core)
            at = [a]
            for i in range(1, parts):
                at.append(_hard(text, a + (b - a) * i // parts, at[-1]))
            cuts += at[1:]
            todo += [(x, y) for x, y in zip(at, [*at[1:], b]) if y - x > core]
            continue
        reach = (b - a) // 4
        near = where[lo:hi][np.searchsorted(where[lo:hi], mid - reach) : np.searchsorted(where[lo:hi], mid + reach, side="right")]
        if len(near) == 0:
            near = where[lo:hi]
            cut = int(near[np.argmin(np.abs(near - mid))])
        else:
            best = near[strength[near] == strength[near].max()]
            cut = int(best[np.argmin(np.abs(best - mid))])
        cuts.append(cut)
        todo += [(a, cut), (cut, b)]
    return sorted(cuts), unbroken


def cut_text(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> tuple[list[tuple[int, int, bool]], list[tuple[int, int]]]:
    """Pieces (start, end, whether the start is a hard cut) of at most ``limit``, and the unbroken parts."""
    if len(text) <= limit:
        return [(0, len(text), False)], []
    strength = _strengths(text)
    cuts, unbroken = _bisect(text, strength, limit - overlap)
    pieces = []
    where = np.flatnonzero(strength)
    for a, b in zip([0, *cuts], [*cuts, len(text)]):
        start, hard = a, bool(a and not strength[a])
        if a:
            reach = max(a - overlap, pieces[-1][0] + 1)
            near = where[np.searchsorted(where, reach) : np.searchsorted(where, a)]
            start = int(near[0]) if len(near) else _hard(text, reach, max(0, reach - 32)) if reach < a else a
            start = start if b - start <= limit else reach
        pieces.append((start, b, hard))
    return pieces, unbroken


def _rows(limit: int, overlap: int, runs: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text in batch.column(2).to_pylist():
                pieces, unbroken = cut_text(text, limit, overlap)
                if runs:
                    pieces = []
                    for a, b in unbroken:
                        # the part's boundary characters, if any, are at its edges
                        own = text[a:b]
                        bare = own.lstrip(BOUNDARY_CHARS)
                        start = a + len(own) - len(bare)
                        pieces.append((start, start + len(bare.rstrip(BOUNDARY_CHARS)), True))
                out.append([{"start": a, "end": b, "hard": hard} for a, b, hard in pieces])
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("hard", pa.bool_())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, kind)], ["parent_id", "h", "pieces"])

    return run


def _cut(df: DataFrame, id_col: str, text_col: str, limit: int, overlap: int, runs: bool) -> DataFrame:
    """(parent_id, start, end, hard): every row is cut where it lies; of the rows of one id the text with the smallest hash counts."""
    kind = df.schema[id_col].dataType.simpleString()
    given = df.select(F.col(id_col).alias("parent_id"), F.xxhash64(F.col(text_col).cast("string")).alias("h"), F.col(text_col).cast("string").alias("text")).filter((F.length("text") > limit) & F.col("parent_id").isNotNull())
    made = given.mapInArrow(_rows(limit, overlap, runs), f"parent_id {kind}, h long, pieces array<struct<start:bigint,`end`:bigint,hard:boolean>>")
    one = made.groupBy("parent_id").agg(F.min(F.struct("h", "pieces")).alias("x"))
    return one.select("parent_id", F.explode("x.pieces").alias("p")).select("parent_id", "p.start", "p.end", "p.hard")


def split_oversized(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """(parent_id, start, end, hard): the pieces of every text over ``limit`` code points.

    Each piece has at most ``limit`` characters and begins up to ``overlap`` before the end of the one
    before, at a boundary if there is one in that stretch. ``hard`` marks pieces whose cut is at no
    boundary because there was none. Repeated rows of an id count once; null ids, null texts and texts
    within the limit give no rows, and so does an empty table.
    """
    return _cut(df, id_col, text_col, limit, overlap, False)


def unbroken_runs(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """(parent_id, run_start, run_end): stretches longer than ``limit`` in which the bisection found no boundary."""
    parts = _cut(df, id_col, text_col, limit, overlap, True)
    return parts.filter(F.col("end") - F.col("start") > limit).select("parent_id", F.col("start").alias("run_start"), F.col("end").alias("run_end"))
