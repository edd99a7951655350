"""Ranked lexical search over all documents, MaxScore in each shard.

A first pass over the documents counts what the weights need: documents, terms, and of each term that is asked for the
documents that hold it. A second one deals the documents of a task into shards of about SHARD_BYTES of text, each an
inverted index of the terms asked for, and runs every query by MaxScore: a term's upper bound is its weight times the
highest share that a document of the shard gets from it; the terms with the lowest bounds whose sum stays below the score
to beat are non-essential. Documents of the essential terms' postings are scored, and the non-essential postings are
probed from the highest bound on, only for documents that could still get among the best. The score to beat goes on from
shard to shard of a task, so later shards need fewer postings. A task sends on at most k documents a query, and these meet
in one ranking.

The queries are a stated set: they are dealt into blocks of bounded size, and each block is sent to the tasks that read
the documents, so no document leaves its task. Several blocks are several scans.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import arrow_map, slices, written

#: Bytes of text in a shard, and of the queries in a block.
SHARD_BYTES, BLOCK_BYTES = 8_000_000, 4_000_000
#: Bytes of a text that are split into terms together.
PIECE = 1 << 20
#: What separates terms, in bytes: all of ASCII but letters and digits. Other bytes are parts of terms.
_SPLIT = bytes(c + 32 if 65 <= c <= 90 else c if c > 127 or chr(c).isalnum() else 32 for c in range(256))
#: A term's share of a document: PEAK tf / (1000 tf + 8 m), m the document's length as a percentage of the mean, damped.
PEAK, SATURATION, LENGTH, DAMPED = 1_000_000_000, 1000, 8, 75


def terms(text: bytes | None) -> list[bytes]:
    """Maximal runs of letters, digits and bytes beyond ASCII; only A to Z in lower case."""
    return (text or b"").translate(_SPLIT).split()


@dataclass(frozen=True)
class Block:
    """Queries (number, item_id, text) of a block: vocabulary by term, each query's terms with how often it has them."""

    numbers: list[int]
    vocabulary: dict[bytes, int]
    queries: list[list[tuple[int, int]]]


def blocks(queries: DataFrame, block_bytes: int = BLOCK_BYTES) -> Iterator[Block]:
    """The queries (number, text) by blocks of about block_bytes; one block at a time comes to the driver."""
    total = queries.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    n = max(1, -(-total // block_bytes))
    for i in range(n):
        part = queries if n == 1 else queries.where(F.pmod(F.xxhash64("number"), F.lit(n)) == i)
        rows = part.select("number", F.encode("text", "UTF-8").alias("text")).orderBy("number").collect()
        vocabulary: dict[bytes, int] = {}
        own = [sorted(Counter(vocabulary.setdefault(t, len(vocabulary)) for t in terms(r["text"])).items()) for r in rows]
        yield Block([r["number"] for r in rows], vocabulary, own)


def weights(block: Block, documents: int, held: dict[int, int]) -> np.ndarray:
    """floor(1000 ln((2 N + 2) / (2 df + 1))) of each term of the vocabulary."""
    return np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * held.get(t, 0) + 1))) for t in range(len(block.vocabulary))], np.int64)


def _found(text: bytes | None, get) -> tuple[int, Counter[int]]:
    """Number of terms of a text, and how often it has each known one; long texts by pieces that end between terms."""
    plain, n, known, at = (text or b"").translate(_SPLIT), 0, Counter(), 0
    while at < len(plain):
        to = plain.find(b" ", at + PIECE) if len(plain) > at + PIECE else -1
        own = plain[at : to if to >= 0 else len(plain)].split()
        n += len(own)
        known.update(t for t in map(get, own) if t is not None)
        at = to if to >= 0 else len(plain)
    return n, known


def _counts(sent):
    """(term, n) of a task: the documents that hold each known term; term -1 counts documents with a term, -2 all terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get, size = sent.value.vocabulary.get, len(sent.value.vocabulary)
        held = np.zeros(size + 2, np.int64)
        for b in batches:
            for s in slices(b.column(1)):
                for text in b.column(1)[s.start : s.stop].cast(pa.binary()).to_pylist():
                    n, known = _found(text, get)
                    held[-1] += n > 0
                    held[-2] += n
                    held[list(known)] += 1
        term = np.append(np.arange(size), [-2, -1])
        some = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(term[some]), pa.array(held[some])], ["term", "n"])

    return run


class Best:
    """The k best (score, doc_id) of a query so far; equal scores by ascending doc_id, none last."""

    def __init__(self, k: int):
        self.k, self.score, self.doc, self.none = k, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
        #: The score that a document has to reach; 1 until there are k.
        self.least = 1

    def add(self, score: np.ndarray, doc: np.ndarray, none: np.ndarray) -> None:
        score, doc, none = np.concatenate((self.score, score)), np.concatenate((self.doc, doc)), np.concatenate((self.none, none))
        order = np.lexsort((doc, none, -score))[: self.k]
        self.score, self.doc, self.none = score[order], doc[order], none[order]
        if len(order) == self.k:
            self.least = int(self.score[-1])


class Shard:
    """The inverted index of a stretch of documents over a block's terms; postings of a term by ascending document."""

    def __init__(self, lengths: list[int], known: list[dict[int, int]], terms_known: int, documents: int, total: int):
        n = np.array(lengths, np.int64)
        damped = 100 - DAMPED + (DAMPED * n * documents) // max(1, total)
        doc = np.repeat(np.arange(len(n)), [len(x) for x in known])
        term, tf = (np.fromiter((t for x in known for t in of(x)), np.int64, len(doc)) for of in (dict.keys, dict.values))
        order = np.argsort(term, kind="stable")
        term, tf, self.doc = term[order], tf[order], doc[order]
        self.share = (PEAK * tf) // (SATURATION * tf + LENGTH * damped[self.doc])
        self.begin = np.searchsorted(term, np.arange(terms_known + 1))
        self.highest = np.zeros(terms_known, np.int64)
        used = np.flatnonzero(np.diff(self.begin))
        if len(used):
            self.highest[used] = np.maximum.reduceat(self.share, self.begin[used])
        self.scores = np.zeros(len(n), np.int64)  # of the query at work; zero in between

    def search(self, query: list[tuple[int, int]], weight: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, int]:
        """Documents whose score may be least or more, their scores, and how many postings were looked at."""
        own = [(int(weight[t]) * n, t) for t, n in query if self.highest[t] and weight[t]]
        own = sorted((int(w * self.highest[t]), w, t) for w, t in own)
        below = np.cumsum([0] + [x[0] for x in own])
        cut = int(np.searchsorted(below[1:], least))  # so many terms together stay below the score to beat
        looked, met = 0, []
        for _, w, t in own[cut:]:
            at = slice(self.begin[t], self.begin[t + 1])
            self.scores[self.doc[at]] += w * self.share[at]
            met.append(self.doc[at])
            looked += len(met[-1])
        docs = np.unique(np.concatenate(met)) if met else np.zeros(0, np.int64)
        score = self.scores[docs]
        self.scores[docs] = 0
        for i in range(cut - 1, -1, -1):
            may = score + below[i + 1] >= least
            docs, score = docs[may], score[may]
            if not len(docs):
                break
            _, w, t = own[i]
            posted = self.doc[self.begin[t] : self.begin[t + 1]]
            at = np.minimum(np.searchsorted(posted, docs), len(posted) - 1)
            score = score + np.where(posted[at] == docs, w * self.share[self.begin[t] + at], 0)
            looked += len(docs)
        good = score >= least
        return docs[good], score[good], looked


def _ranked(sent, weight: np.ndarray, documents: int, total: int, k: int, shard_bytes: int):
    """(number, doc_id, score) of a task's k best documents of each query of a block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = sent.value
        get, best = block.vocabulary.get, [Best(k) for _ in block.queries]
        lengths: list[int] = []
        known: list[dict[int, int]] = []
        ids: list[int | None] = []

        def close() -> None:
            shard = Shard(lengths, known, len(block.vocabulary), documents, total)
            none = np.array([i is None for i in ids])
            doc = np.array([i or 0 for i in ids], np.int64)
            for query, b in zip(block.queries, best):
                found, score, _ = shard.search(query, weight, b.least)
                if len(found):
                    b.add(score, doc[found], none[found])
            lengths.clear(), known.clear(), ids.clear()

        held = 0
        for b in batches:
            for s in slices(b.column(1)):
                for i, text in zip(b.column(0)[s.start : s.stop].to_pylist(), b.column(1)[s.start : s.stop].cast(pa.binary()).to_pylist()):
                    n, own = _found(text, get)
                    held += len(text or b"")
                    if own:
                        lengths.append(n), known.append(own), ids.append(i)
                    if held >= shard_bytes:
                        close()
                        held = 0
        close()
        for number, b in zip(block.numbers, best):
            if len(b.score):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(b.score), number, np.int64)), pa.array(b.doc, mask=b.none), pa.array(b.score)], ["number", "doc_id", "score"])

    return run


def search(docs: DataFrame, queries: DataFrame, *, k: int = 10, shard_bytes: int = SHARD_BYTES, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(item_id, rank, doc_id, score) of the k best rows of docs (doc_id, text) for each query (item_id, text).

    Equal scores go by ascending doc_id, rows without one last; a rank is given once a query. Null and empty texts hold no
    term and are never found; a query without a term finds nothing. A doc_id's repeated rows are documents of their own,
    and rank side by side. Repeated queries are answered once, different texts of one item_id each for itself, null
    item_ids too. Texts of any length are one document. Without documents or queries the result is empty. Extra columns,
    whatever their names, play no part.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    asked = queries.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text IS NOT NULL").distinct()
    asked = written(asked.withColumn("number", F.monotonically_increasing_id()), "search-queries")
    found = []
    for block in blocks(asked, block_bytes):
        sent = spark.sparkContext.broadcast(block)
        counts = arrow_map(rows, _counts(sent), "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
        counts = {r["term"]: r["n"] for r in counts.collect()}  # a row a term asked for, as the block is bounded
        documents, total = counts.pop(-1, 0), counts.pop(-2, 0)
        best = arrow_map(rows, _ranked(sent, weights(block, documents, counts), documents, total, k, shard_bytes), "number long, doc_id long, score long")
        found.append(best)
    met = written(reduce(DataFrame.unionByName, found), f"search-{uuid4().hex[:8]}")
    first = Window.partitionBy("number").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    ranked = met.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= k)
    return ranked.join(asked.select("number", "item_id"), "number").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def op11(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The ten best documents of each benchmark item; odd rows are treated as by `search`."""
    return search(docs, benchmark, k=10)


#: op11 in SQL for DuckDB: every score of every document that shares a term with an item.
OP11_SQL = r"""
WITH words AS (
  SELECT row, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM (SELECT row_number() OVER () AS row, doc_id, text FROM documents)
), tfs AS MATERIALIZED (
  SELECT row, doc_id, term, count(*) AS tf FROM words GROUP BY ALL
), lengths AS MATERIALIZED (
  SELECT row, CAST(sum(tf) AS BIGINT) AS n FROM tfs GROUP BY row
), totals AS (
  SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS all_terms FROM lengths
), dfs AS (
  SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tfs, totals GROUP BY term, docs
), asked AS (
  SELECT number, item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM (SELECT row_number() OVER () AS number, * FROM (SELECT DISTINCT item_id, text FROM benchmark))
), query AS (
  SELECT number, item_id, term, count(*) AS times FROM asked GROUP BY ALL
), scores AS (
  SELECT q.number, q.item_id, t.doc_id, t.row,
         CAST(sum(q.times * d.w * ((1000000000 * t.tf) // (1000 * t.tf + 8 * (100 - 75 + (75 * l.n * docs) // all_terms)))) AS BIGINT) AS score
  FROM query q JOIN dfs d ON d.term = q.term JOIN tfs t ON t.term = q.term JOIN lengths l ON l.row = t.row, totals GROUP BY ALL
)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY number ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM scores WHERE score > 0
) WHERE rank <= 10
"""
