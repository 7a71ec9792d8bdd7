"""BM25 over an inverted index that is built once.

The index is a table of blocks of documents, each with its own postings, and a table of document
counts by term. It can be written and read again; a search tokenizes the questions only.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from querent.functions.text import bm25_term, canonical_hash, check_k, idf, tokens
from querent.operators.blocks import packed, search_blocks, unpacked, visit_blocks
from querent.operators.rank import rank_in_query
from querent.plans.staging import Stage

K1, B, TITLE_WEIGHT = 1.5, 0.75, 1.0
#: Documents of a block of the index, and questions of a block; their product is one matrix of scores.
BLOCK_DOCS, BLOCK_QUERIES = 8192, 256
#: Questions of a block that are counted together, those united at a time, blocks in a task's group, and terms that are held as bits at a time.
COUNTED_QUERIES, UNITED_QUERIES, VISITED, COUNTED_TERMS = 16_384, 512, 16, 32_768
#: Words of documents of a block in which candidates are counted, which grows by pieces of so many documents.
BLOCK_WORDS, PIECE_DOCS = 2_000_000, 256


def check_parameters(k1: float, b: float, title_weight: float) -> None:
    for name, value in (("k1", k1), ("b", b), ("title_weight", title_weight)):
        if isinstance(value, bool) or not math.isfinite(value) or value < 0 or (name == "b" and value > 1):
            raise ValueError(f"{name} is out of range")


def _weighted(corpus: DataFrame, title_weight: float) -> DataFrame:
    """doc_id, words (of text and title with weights), len; one pass over the texts."""
    words = lambda c, w: F.transform(tokens(F.coalesce(F.col(c), F.lit(""))), lambda t: F.struct(t.alias("term"), F.lit(float(w)).alias("w")))
    parts = words("text", 1.0) if title_weight == 0 else F.concat(words("text", 1.0), words("title", title_weight))
    return corpus.select("doc_id", parts.alias("words")).withColumn("len", F.aggregate("words", F.lit(0.0), lambda s, x: s + x["w"]))


def postings(corpus: DataFrame, title_weight: float = TITLE_WEIGHT) -> DataFrame:
    """(term, doc_id, tf, len): the inverted index; tf of a title counts ``title_weight`` times."""
    check_parameters(K1, B, title_weight)
    each = _weighted(corpus, title_weight).select("doc_id", "len", F.explode("words").alias("x"))
    return each.groupBy(F.col("x.term").alias("term"), "doc_id").agg(F.sum("x.w").alias("tf"), F.first("len").alias("len"))


def doc_stats(corpus: DataFrame, title_weight: float = TITLE_WEIGHT) -> DataFrame:
    """(doc_id, len): documents without a token count, with length 0."""
    return _weighted(corpus, title_weight).select("doc_id", "len")


def term_stats(index: DataFrame) -> DataFrame:
    return index.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def query_terms(queries: DataFrame) -> DataFrame:
    """(query_id, term): the distinct terms of each question."""
    return queries.select("query_id", F.explode(F.array_distinct(tokens(F.coalesce("question", F.lit(""))))).alias("term"))


def candidates(queries: DataFrame, corpus: DataFrame) -> DataFrame:
    """(query_id, doc_id): documents that share a term with the question; for their numbers ``candidate_counts`` makes no pairs."""
    wanted = query_terms(queries)
    return postings(corpus, 0.0).select("term", "doc_id").join(wanted, "term").select("query_id", "doc_id").distinct()


def _collection(corpus: DataFrame, title_weight: float):
    """Number of documents and mean length as scalar subqueries: one aggregate, no cross join."""
    lens = doc_stats(corpus, title_weight)
    return lens.agg(F.count(F.lit(1)).cast("double")).scalar(), lens.agg(F.avg("len")).scalar()


@dataclass(frozen=True)
class Index:
    """``blocks`` (doc_id, len, term, start, doc, tf: arrays), ``terms`` (term, df), the number of documents and their mean length."""

    blocks: DataFrame
    terms: DataFrame
    documents: int
    mean: float
    title_weight: float
    #: Of the documents, whatever their order.
    fingerprint: str

    def save(self, path: str) -> None:
        """Writes the index to a new folder of the shared file system; its facts come last."""
        self.blocks.write.parquet(f"{path}/blocks")
        self.terms.write.parquet(f"{path}/terms")
        facts = {"documents": self.documents, "mean": self.mean, "title_weight": self.title_weight, "fingerprint": self.fingerprint}
        spark = self.blocks.sparkSession
        spark.createDataFrame([(json.dumps(facts),)], "value string").coalesce(1).write.text(f"{path}/facts")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Index:
        facts = json.loads(spark.read.text(f"{path}/facts").first()["value"])
        return cls(spark.read.parquet(f"{path}/blocks"), spark.read.parquet(f"{path}/terms"), **facts)


def _postings_of_blocks(size: int, title_weight: float):
    """Blocks of documents with their postings, sorted by term."""

    def one(t: pa.Table) -> pa.RecordBatch:
        t = t.combine_chunks()
        n = t.num_rows
        owners, words, weights = [], [], []
        for name, weight in (("text", 1.0), ("title", title_weight)):
            column = pa.concat_arrays(t[name].chunks)
            sizes = np.asarray(pc.fill_null(pc.list_value_length(column), 0))
            if weight:
                owners.append(np.repeat(np.arange(n), sizes))
                words.append(column.flatten())
                weights.append(np.full(int(sizes.sum()), weight))
        owner, weight = np.concatenate(owners), np.concatenate(weights)
        coded = pa.concat_arrays(words).dictionary_encode()
        order = pc.array_sort_indices(coded.dictionary)
        place = np.empty(len(coded.dictionary), np.int64)
        place[np.asarray(order)] = np.arange(len(order))
        code = place[np.asarray(coded.indices)] if len(coded) else np.zeros(0, np.int64)
        keys, back = np.unique(code * n + owner, return_inverse=True)
        tf = np.bincount(back, weights=weight, minlength=len(keys)).astype(np.float64)
        start = np.searchsorted(keys // n, np.arange(len(order) + 1)) if n else np.zeros(1, int)
        length = np.bincount(owner, weights=weight, minlength=n).astype(np.float64)
        cols = {"doc_id": pa.concat_arrays(t["doc_id"].chunks), "len": pa.array(length), "term": coded.dictionary.take(order), "start": pa.array(start.astype(np.int32)), "doc": pa.array((keys % n).astype(np.int32)), "tf": pa.array(tf)}
        return pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), c) for c in cols.values()], list(cols))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            if b.num_rows:
                held.append(b)
            while sum(x.num_rows for x in held) >= size:
                t = pa.Table.from_batches(held)
                yield one(t.slice(0, size))
                held = [x for x in t.slice(size).to_batches() if x.num_rows]
        if held:
            yield one(pa.Table.from_batches(held))

    return run


def build_index(corpus: DataFrame, title_weight: float = TITLE_WEIGHT, block_docs: int = BLOCK_DOCS) -> Index:
    """The index of a corpus (doc_id, title, text); one tokenization, documents stay where they lie.

    Null titles and texts are empty; documents without a term count with length 0.
    """
    check_parameters(K1, B, title_weight)
    stage = Stage(corpus.sparkSession, "bm25")
    words = corpus.select("doc_id", tokens(F.coalesce("text", F.lit(""))).alias("text"), tokens(F.coalesce("title", F.lit(""))).alias("title"))
    kind = dict(corpus.dtypes)["doc_id"]
    shape = f"doc_id array<{kind}>, len array<double>, term array<string>, start array<int>, doc array<int>, tf array<double>"
    blocks = stage.write(words.mapInArrow(_postings_of_blocks(block_docs, title_weight), shape), "blocks")
    counts = F.transform("term", lambda t, i: F.struct(t.alias("term"), (F.get("start", i + 1) - F.get("start", i)).alias("n")))
    terms = stage.write(blocks.select(F.explode(counts).alias("x")).groupBy("x.term").agg(F.sum("x.n").alias("df")), "terms")
    hashed = F.aggregate("doc_id", F.lit(0).cast("decimal(38,0)"), lambda s, d: (s + F.xxhash64(d)).cast("decimal(38,0)"))
    facts = blocks.agg(F.sum(F.size("doc_id")).alias("n"), F.sum(F.aggregate("len", F.lit(0.0), lambda s, x: s + x)).alias("len"), F.sum(hashed).alias("ids")).first()
    n = facts["n"] or 0
    return Index(blocks, terms, n, facts["len"] / n if n else 0.0, float(title_weight), canonical_hash([n, facts["len"], str(facts["ids"]), float(title_weight)]))


def _terms_of_blocks(size: int, most: int):
    """Blocks of documents with the documents of each term; a block has at most ``size`` documents and, but for its last piece, ``most`` words."""

    def one(held: list[pa.Array]) -> pa.RecordBatch:
        lists = pa.concat_arrays(held)
        coded = lists.flatten().dictionary_encode()
        code = np.asarray(coded.indices)
        doc = np.repeat(np.arange(len(lists), dtype=np.int16), np.asarray(pc.fill_null(pc.list_value_length(lists), 0)))[np.argsort(code, kind="stable")]
        start = np.r_[0, np.cumsum(np.bincount(code, minlength=len(coded.dictionary)))].astype(np.int32)
        cols = [pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), c) for c in (coded.dictionary, pa.array(start), pa.array(doc))]
        return pa.RecordBatch.from_arrays([pa.array([len(lists)], pa.int32()), *cols], ["documents", "term", "start", "doc"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows, words = [], 0, 0
        for b in batches:
            lo = 0
            while lo < b.num_rows:
                piece = b["words"].slice(lo, min(PIECE_DOCS, size - rows))
                lo, rows, words = lo + len(piece), rows + len(piece), words + len(piece.flatten())
                held.append(piece)
                if rows >= size or words >= most:
                    yield one(held)
                    held, rows, words = [], 0, 0
        if held:
            yield one(held)

    return run


def _sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The questions' words as a compressed stream with each word once: every block of documents gets a copy."""
    for b in batches:
        for i in range(b.num_rows):
            lists = b["words"][i].values
            coded, size = lists.flatten().dictionary_encode(), np.asarray(pc.list_value_length(lists))
            code = np.asarray(coded.indices)
            often = np.argsort(-np.bincount(code, minlength=len(coded.dictionary)), kind="stable")
            rank = np.empty(len(often), np.int32)
            rank[often] = np.arange(len(often))
            rank = rank[code]
            rank = rank[np.lexsort((rank, np.repeat(np.arange(len(size)), size)))]  # frequent words first: fewer bytes
            cols = [pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), c) for c in (coded.dictionary.take(pa.array(often)), pa.array(rank), pa.array(size))]
            out, t = pa.BufferOutputStream(), pa.RecordBatch.from_arrays(cols, ["word", "code", "size"])
            with pa.ipc.new_stream(out, t.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as stream:
                stream.write_batch(t)
            yield pa.RecordBatch.from_arrays([b["query_id"].slice(i, 1), pa.array([out.getvalue().to_pybytes()], pa.binary())], ["query_id", "words"])


def _bits(terms: np.ndarray, start: np.ndarray, doc: np.ndarray, documents: int) -> np.ndarray:
    """A row of bits for each term, of the documents that have it; the last row, of no term, has none."""
    width = -(-documents // 64)
    out = np.zeros((len(terms) + 1, width), np.uint64)
    sizes = start[terms + 1] - start[terms]
    ends = np.cumsum(sizes)
    own = doc[np.arange(ends[-1]) + np.repeat(start[terms] - ends + sizes, sizes)].astype(np.int64)
    cell = np.repeat(np.arange(len(terms)) * width, sizes) + (own >> 6)
    # documents rise within a term, so that those of a cell stand together
    edges = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
    out.ravel()[cell[edges]] = np.bitwise_or.reduceat(np.uint64(1) << (own & 63).astype(np.uint64), edges)
    return out


def _united(place: np.ndarray, code: np.ndarray, size: np.ndarray, start: np.ndarray, doc: np.ndarray, documents: int) -> np.ndarray:
    """For each question the number of documents that have a word of it; ``place`` is that of a word among the block's terms, or -1."""
    owner, here = np.repeat(np.arange(len(size)), size), place[code] >= 0
    code, own = code[here], np.bincount(owner[here], minlength=len(size))
    first, order = np.cumsum(own) - own, np.argsort(-own, kind="stable")
    first, own = first[order], own[order]
    found = np.zeros((len(size), -(-documents // 64)), np.uint64)
    present = np.flatnonzero(place >= 0)
    for lo in range(0, len(present), COUNTED_TERMS):
        mine = present[lo : lo + COUNTED_TERMS]
        bits = _bits(place[mine], start, doc, documents)
        row = np.full(len(place), len(mine))
        row[mine] = np.arange(len(mine))
        row = row[code]
        for q in range(0, len(size), UNITED_QUERIES):
            sizes, begin = own[q : q + UNITED_QUERIES], first[q : q + UNITED_QUERIES]
            for j in range(sizes[0]):
                live = np.searchsorted(-sizes, -j)  # the longest questions come first
                found[q : q + live] |= bits[row[begin[:live] + j]]
    out = np.empty(len(size), np.int64)
    out[order] = np.bitwise_count(found).sum(axis=1, dtype=np.int64)
    return out


def _count_in_block(own: pa.Table, asking: pa.Table) -> pa.Table:
    at, counts = [], []
    if own.num_rows and asking.num_rows:
        start, doc = (np.asarray(unpacked(own[c])) for c in ("start", "doc"))
        terms, documents = unpacked(own["term"]), own["documents"][0].as_py()
        for i in range(asking.num_rows):
            sent = pa.ipc.open_stream(asking["words"][i].as_buffer()).read_next_batch()
            word, code, size = (sent[c][0].values for c in ("word", "code", "size"))
            place = np.asarray(pc.fill_null(pc.index_in(word, terms), -1))
            at.append(asking["at"][i].as_py())
            counts.append(_united(place, np.asarray(code), np.asarray(size), start, doc, documents).astype(np.int16))
    return pa.table({"at": pa.array(at, pa.int64()), "counts": pa.array(counts, pa.list_(pa.int16()))})


def _sum_of_blocks(asked: pa.Table, found: pa.Table) -> pa.Table:
    ids = unpacked(asked["query_id"])
    total = np.zeros(len(ids), np.int64)
    for i in range(found.num_rows):
        total += np.asarray(unpacked(found["counts"], i))
    some = pa.array(np.flatnonzero(total))
    return pa.table({"query_id": ids.take(some), "candidates": pa.array(total).take(some)})


def candidate_counts(queries: DataFrame, corpus: DataFrame, title_weight: float = 0.0, block_docs: int = BLOCK_DOCS) -> DataFrame:
    """(query_id, candidates): how many documents share a term with the question; questions without one have no row.

    In each block of documents a term is a row of bits, and a question the union of its terms' rows: no pair
    of question and document is made. What is shuffled are the blocks and a number a question and block.
    A title counts unless its weight is 0; a corpus has an id once.
    """
    check_parameters(K1, B, title_weight)
    if not 1 <= block_docs <= 32_767:
        raise ValueError("block_docs must be from 1 to 32767")
    stage = Stage(queries.sparkSession, "bm25-candidates")
    words = lambda *names: F.array_distinct(F.concat(*[tokens(F.coalesce(F.col(c), F.lit(""))) for c in names]))
    held = corpus.select(words("text", "title") if title_weight else words("text")).toDF("words")
    own = stage.write(held.mapInArrow(_terms_of_blocks(block_docs, BLOCK_WORDS), "documents int, term array<string>, start array<int>, doc array<smallint>"), "blocks")
    asked = queries.groupBy("query_id").agg(F.array_distinct(F.flatten(F.collect_list(words("question")))).alias("words"))
    kind = dict(queries.dtypes)["query_id"]
    sent = packed(asked, COUNTED_QUERIES).mapInArrow(_sent, f"query_id array<{kind}>, words binary")
    blocks = stage.write(sent.withColumn("at", F.monotonically_increasing_id()), "questions")
    counts = visit_blocks(own, blocks.drop("query_id"), F.col("at"), _count_in_block, "at bigint, counts array<smallint>", VISITED)
    return blocks.select("at", "query_id").groupBy("at").cogroup(counts.groupBy("at")).applyInArrow(_sum_of_blocks, f"query_id {kind}, candidates bigint")


def _scores(k1: float, b: float, mean: float):
    def run(own: pa.Table, asking: pa.Table, i: int) -> np.ndarray:
        length = np.asarray(unpacked(own["len"]))
        start, doc, tf = (np.asarray(unpacked(own[c])) for c in ("start", "doc", "tf"))
        lists = unpacked(asking["words"], i)
        sizes = np.asarray(pc.list_value_length(lists))
        words = lists.flatten()
        query = np.repeat(np.arange(len(lists)), sizes)
        term = pc.index_in(words.field("term"), unpacked(own["term"])).to_numpy(zero_copy_only=False)
        weight = np.asarray(words.field("idf"))
        here = ~np.isnan(term)
        query, term, weight = query[here], term[here].astype(np.int64), weight[here]
        part = tf * (k1 + 1) / (tf + k1 * (1 - b + b * length[doc] / mean)) if mean else tf * 0.0
        out = np.zeros((len(lists), len(length)))
        order = np.argsort(term, kind="stable")
        edges = np.flatnonzero(np.r_[True, np.diff(term[order]) != 0, True]) if len(order) else np.zeros(1, int)
        for lo, hi in zip(edges[:-1], edges[1:]):
            at = order[lo:hi]
            own_docs = slice(start[term[at[0]]], start[term[at[0]] + 1])
            # a question has a term once, so no place is added to twice
            out[query[at][:, None], doc[own_docs][None, :]] += weight[at][:, None] * part[own_docs][None, :]
        return out

    return run


def search_index(queries: DataFrame, index: Index, k: int = 5, k1: float = K1, b: float = B) -> DataFrame:
    """(query_id, doc_id, score, rank): the k best documents with a positive score, equal ones by id."""
    check_k(k)
    check_parameters(k1, b, index.title_weight)
    stage = Stage(queries.sparkSession, "bm25-search")
    weighted = query_terms(queries).join(index.terms, "term").select("query_id", F.struct("term", idf(F.lit(float(index.documents)), F.col("df")).alias("idf")).alias("w"))
    asked = weighted.groupBy("query_id").agg(F.array_sort(F.collect_list("w")).alias("words"))
    blocks = stage.write(packed(asked, BLOCK_QUERIES), "questions")
    kinds = dict(asked.dtypes)["query_id"], dict(index.blocks.dtypes)["doc_id"].removeprefix("array<").removesuffix(">")
    return rank_in_query(search_blocks(index.blocks, blocks, _scores(k1, b, index.mean), k, kinds, above=0.0), k)


def search(queries: DataFrame, corpus: DataFrame, k: int = 5, k1: float = K1, b: float = B, title_weight: float = TITLE_WEIGHT) -> DataFrame:
    """As ``search_index``, on an index that is built for this call."""
    check_parameters(k1, b, title_weight)
    return search_index(queries, build_index(corpus, title_weight), k, k1, b)


def explain(queries: DataFrame, corpus: DataFrame, doc_id: str, k1: float = K1, b: float = B, title_weight: float = TITLE_WEIGHT) -> DataFrame:
    """(query_id, term, tf, idf, part) for one document, with zero rows for terms it lacks; an unknown document is an error."""
    if corpus.filter(F.col("doc_id") == doc_id).limit(1).count() == 0:
        raise ValueError(f"unknown document: {doc_id}")
    asked = query_terms(queries)
    index = postings(corpus, title_weight).join(asked.select("term").distinct(), "term", "left_semi")
    n, mean = _collection(corpus, title_weight)
    own = index.filter(F.col("doc_id") == doc_id).select("term", "tf", "len")
    joined = asked.join(term_stats(index), "term", "left").join(own, "term", "left").fillna(0, ["df", "tf", "len"])
    weight = idf(n, F.col("df"))
    return joined.select("query_id", "term", "tf", weight.alias("idf"), F.when(F.col("tf") > 0, bm25_term(weight, F.col("tf"), F.col("len"), mean, k1, b)).otherwise(0.0).alias("part"))
