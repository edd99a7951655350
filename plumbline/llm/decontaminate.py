"""Benchmark decontamination by greedy string tiling.

Documents and benchmark items are sequences of lower-cased words (runs of letters, digits and underscores). Windows
of min_match words (of an item with fewer words: all of these) that a document shares with an item are seeds. Where an
item's seeds cover enough of its words, the pair is tiled: all maximal matches grow from the seeds, and again and again the longest that overlaps no earlier
tile is marked, what earlier tiles cut off a match counting as a shorter match. Karp-Rabin hashes of the windows
find the matches and words confirm them. The share of an item's words under tiles decides, so passages in another
order, or with something in between, are found as well.

A document that covers c of an item's W words by tiles of k words or more shares c W / k of its windows at least. So the
c W / k - 1 windows of an item that most other items have, such as those of a common question, name no candidates; the
others find every document that counts, and few besides.

The benchmark is a stated query set. Its different texts are dealt into blocks of at most about block_words words, and
each block, whose size is thus bounded, is sent to the tasks that read the documents; no row leaves its task.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from itertools import repeat
from math import ceil
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import arrow_map, slices

WORDS = re.compile(r"\w+")
#: Window pairs, and candidate pairs' windows, looked at together; bounds memory whatever repeats.
AT_ONCE = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)


def words(text: str | None) -> list[str]:
    return WORDS.findall((text or "").lower())


def _rolling(ids: np.ndarray, k: int) -> np.ndarray:
    """Karp-Rabin hashes, modulo 2 ** 64, of all windows of k ids; ids are spread first."""
    x = ids.astype(np.uint64)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    h = np.zeros(max(len(x) - k + 1, 0), np.uint64)
    for j in range(k):
        h = h * _BASE + x[j : j + len(h)]
    return h


def _expanded(lo: np.ndarray, up: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each range [lo, up): its number, once an element, and the elements, end to end."""
    n = up - lo
    return np.repeat(np.arange(len(n)), n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n - lo, n)


def maximal(item: np.ndarray, doc: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """(start in item, start in doc, length) of every match of k words or more that can't be extended.

    Only starts and ends of matches are held; windows that are equal are met by blocks, so words that repeat often cost
    time but no memory.
    """
    hi, hd = _rolling(item, k), _rolling(doc, k)
    order = np.argsort(hi, kind="stable")
    lo, up = np.searchsorted(hi[order], hd, "left"), np.searchsorted(hi[order], hd, "right")
    some = np.flatnonzero(up > lo)
    total = np.cumsum(up[some] - lo[some])
    edges: list[list[np.ndarray]] = [[], []]
    at = 0
    while at < len(some):
        to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + AT_ONCE, "right")))
        n, i = _expanded(lo[some[at:to]], up[some[at:to]])
        i, j = order[i], some[at:to][n]
        first = (i == 0) | (j == 0) | (hi[i - 1] != hd[j - 1])
        last = (i == len(hi) - 1) | (j == len(hd) - 1) | (hi[np.minimum(i + 1, len(hi) - 1)] != hd[np.minimum(j + 1, len(hd) - 1)])
        for out, which in zip(edges, (first, last)):
            out.append(np.stack((j[which] - i[which], i[which])))
        at = to
    if not edges[0]:
        return []
    starts, ends = (np.concatenate(x, axis=1) for x in edges)
    starts, ends = (x[:, np.lexsort((x[1], x[0]))] for x in (starts, ends))  # by diagonal: a match's start, then its end
    out = zip(starts[1].tolist(), (starts[1] + starts[0]).tolist(), (ends[1] - starts[1] + k).tolist())
    return [(a, b, m) for a, b, m in out if (item[a : a + m] == doc[b : b + m]).all()]


def tile(item: np.ndarray, doc: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling: (start in item, start in doc, length) of each tile, of k words at least.

    Of matches of one length, the first in the item and then in the document goes first.
    """
    heap = [(-m, a, b) for a, b, m in maximal(item, doc, k)]
    heapq.heapify(heap)
    free_item, free_doc = np.ones(len(item), bool), np.ones(len(doc), bool)
    tiles, left = [], len(item)
    while heap and left >= k:
        m, a, b = heapq.heappop(heap)
        m = -m
        free = free_item[a : a + m] & free_doc[b : b + m]
        if free.all():
            free_item[a : a + m] = free_doc[b : b + m] = False
            left -= m
            tiles.append((a, b, m))
            continue
        edges = np.flatnonzero(np.diff(np.concatenate(([0], free.astype(np.int8), [0]))))
        for s, e in zip(edges[::2].tolist(), edges[1::2].tolist()):
            if e - s >= k:
                heapq.heappush(heap, (s - e, a + s, b + s))
    return tiles


class _Seeds:
    """The windows of the items that have seeds of one width."""

    def __init__(self, numbers: np.ndarray, items: list[np.ndarray], width: int, coverage: float):
        hashes = [_rolling(items[i], width) for i in numbers]
        self.width, self.n = width, np.array([len(h) for h in hashes], np.int64)
        self.number, self.begin, self.h = numbers, np.cumsum(self.n) - self.n, np.concatenate(hashes)
        of = np.repeat(np.arange(len(numbers)), self.n)
        self.all, inverse, often = np.unique(self.h, return_inverse=True, return_counts=True)
        rank = np.empty(len(of), np.int64)
        rank[np.lexsort((-often[inverse], of))] = np.arange(len(of)) - np.repeat(self.begin, self.n)
        least = np.array([ceil(coverage * len(items[i]) / width - 1e-9) for i in numbers])
        naming = np.flatnonzero(rank >= (np.maximum(least, 1) - 1)[of])
        naming = naming[np.argsort(self.h[naming], kind="stable")]
        self.naming, self.of = self.h[naming], of[naming]

    def candidates(self, doc: np.ndarray, h: np.ndarray, least: np.ndarray) -> Iterator[tuple[int, int]]:
        """(document, item) of the pairs whose shared windows cover least words of the item or more; doc and h: the documents' windows."""
        pairs = np.unique(np.stack((doc.astype(np.uint64), h)), axis=1)
        doc, h = pairs[0].astype(np.int64), pairs[1]
        marks = np.sort(_marked(doc, h))
        lo, up = np.searchsorted(self.naming, h, "left"), np.searchsorted(self.naming, h, "right")
        total = np.cumsum(up - lo)
        found, at = [np.zeros((2, 0), np.int64)], 0
        while at < len(doc):
            to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + AT_ONCE, "right")))
            n, entry = _expanded(lo[at:to], up[at:to])
            found.append(np.unique(np.stack((doc[at:to][n], self.of[entry])), axis=1))
            at = to
        found = np.unique(np.concatenate(found, axis=1), axis=1)
        size, at = np.cumsum(self.n[found[1]]), 0
        while at < found.shape[1]:
            to = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + AT_ONCE, "right")))
            d, own = found[:, at:to]
            pair, entry = _expanded(self.begin[own], self.begin[own] + self.n[own])
            mark = _marked(d[pair], self.h[entry])
            there = marks[np.minimum(np.searchsorted(marks, mark), len(marks) - 1)] == mark
            pair, entry = pair[there], entry[there]
            gap = np.full(len(pair), self.width)
            gap[:-1] = np.where(pair[1:] == pair[:-1], np.minimum(entry[1:] - entry[:-1], self.width), self.width)
            covered = np.bincount(pair, gap, to - at)
            for i in np.flatnonzero(covered >= least[own]).tolist():
                yield int(d[i]), int(own[i])
            at = to


def _marked(doc: np.ndarray, h: np.ndarray) -> np.ndarray:
    x = (h ^ (doc.astype(np.uint64) + np.uint64(1)) * _BASE) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ x >> np.uint64(31)


class Index:
    """Seeds of a block of benchmark items (name, text)."""

    def __init__(self, items: list[tuple[str, str | None]], k: int, coverage: float):
        self.names, self.coverage = [x[0] for x in items], coverage
        split = [words(t) for _, t in items]
        self.vocabulary = {w: n for n, w in enumerate(dict.fromkeys(w for ws in split for w in ws), 1)}
        self.items = [np.array([self.vocabulary[w] for w in ws], np.int64) for ws in split]
        width = np.array([min(k, len(x)) for x in self.items], np.int64)
        self.seeds = [_Seeds(np.flatnonzero(width == w), self.items, int(w), coverage) for w in np.unique(width[width > 0])]
        self.least = np.array([coverage * len(x) - 1e-9 for x in self.items])

    def find(self, texts: list[str | None]) -> Iterator[tuple[int, int, int, int, int]]:
        """(text, item, words of the item, words under tiles, tiles) of each pair with that coverage or more."""
        get = self.vocabulary.get
        docs = []
        for t in texts:
            ws = words(t)
            docs.append(np.fromiter(map(get, ws, repeat(0)), np.int64, len(ws)))
        flat = np.concatenate([x for d in docs for x in (d, np.zeros(1, np.int64))])
        begin = np.cumsum([0] + [len(d) + 1 for d in docs])
        unknown = np.concatenate(([0], np.cumsum(flat == 0)))
        for s in self.seeds:
            inside = np.flatnonzero(unknown[s.width :] == unknown[: -s.width]) if len(flat) >= s.width else np.zeros(0, np.int64)
            if not len(inside):
                continue
            h = _rolling(flat, s.width)[inside]
            hit = s.all[np.minimum(np.searchsorted(s.all, h), len(s.all) - 1)] == h
            if not hit.any():
                continue
            of = np.searchsorted(begin, inside[hit], "right") - 1
            for d, own in s.candidates(of, h[hit], self.least[s.number]):
                i = int(s.number[own])
                tiles = tile(self.items[i], docs[d], s.width)
                matched = sum(t[2] for t in tiles)
                if matched >= self.least[i]:
                    yield d, i, len(self.items[i]), matched, len(tiles)


_indexes: dict[str, Index] = {}


def _index(name: str, sent, min_match: int, coverage: float) -> Index:
    """The index of a block that was sent, built once a worker."""
    if name not in _indexes:
        if len(_indexes) > 3:
            _indexes.clear()
        _indexes[name] = Index(sent.value, min_match, coverage)
    return _indexes[name]


def _texts(benchmark: DataFrame) -> DataFrame:
    """(item, text, item_id) of the rows that have a text; item names the text."""
    own = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text IS NOT NULL")
    return own.withColumn("item", F.sha2("text", 256))


def _blocks(benchmark: DataFrame, block_words: int) -> Iterator[list[tuple[str, str]]]:
    """(item, text) of the different texts, by blocks; one block at a time comes to the driver."""
    rows = _texts(benchmark).select("item", "text").distinct()
    total = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-total // (6 * block_words)))  # of six code points a word and space
    for n in range(blocks):
        part = rows if blocks == 1 else rows.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == n)
        yield [(r["item"], r["text"]) for r in part.sort("item").collect()]


def contaminated(docs: DataFrame, benchmark: DataFrame, *, min_match: int = 5, coverage: float = 0.8, block_words: int = 2_000_000) -> DataFrame:
    """(doc_id, item_id, item_words, matched_words, tiles, coverage) of each document that holds an item.

    Null and empty texts hold nothing and are held nowhere. An item of fewer than min_match words is held by documents
    in which these follow each other. Repeated rows on either side give a row each; null ids stay null. Texts of any
    length are searched whole. Extra columns, whatever their names, play no part. An empty table gives an empty result.
    """
    spark, found = docs.sparkSession, None
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    schema = "doc_id long, item string, item_words long, matched_words long, tiles long"
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
    for items in _blocks(benchmark, block_words):
        sent, name = spark.sparkContext.broadcast(items), uuid4().hex

        def run(batches: Iterator[pa.RecordBatch], sent=sent, name=name) -> Iterator[pa.RecordBatch]:
            index = _index(name, sent, min_match, coverage)
            for b in batches:
                for s in slices(b.column(1)):
                    ids = b.column(0)[s.start : s.stop].to_pylist()
                    got = [(ids[d], index.names[i], *n) for d, i, *n in index.find(b.column(1)[s.start : s.stop].to_pylist())]
                    if got:
                        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*got), kinds)], ["doc_id", "item", "item_words", "matched_words", "tiles"])

        one = arrow_map(rows, run, schema)
        found = one if found is None else found.unionByName(one)
    named = found.join(_texts(benchmark).select("item", "item_id"), "item")
    return named.select("doc_id", "item_id", "item_words", "matched_words", "tiles", F.round(F.col("matched_words") / F.col("item_words"), 6).alias("coverage"))


def keep_clean(docs: DataFrame, benchmark: DataFrame, *, min_match: int = 5, coverage: float = 0.8, block_words: int = 2_000_000) -> DataFrame:
    """docs without the rows whose text holds a benchmark item, as `contaminated` says; rows stay in their task.

    Columns stay as they are, whatever their names. Rows without a text or a doc_id stay unless their text holds an item;
    repeated rows are judged each. Without benchmark texts all rows stay.
    """
    at = docs.columns.index("text")
    for items in _blocks(benchmark, block_words):
        sent, name = docs.sparkSession.sparkContext.broadcast(items), uuid4().hex

        def run(batches: Iterator[pa.RecordBatch], sent=sent, name=name) -> Iterator[pa.RecordBatch]:
            index = _index(name, sent, min_match, coverage)
            for b in batches:
                keep = np.ones(len(b), bool)
                for s in slices(b.column(at)):
                    for d, *_ in index.find(b.column(at)[s.start : s.stop].to_pylist()):
                        keep[s.start + d] = False
                yield b.filter(pa.array(keep))

        docs = arrow_map(docs, run, docs.schema)
    return docs
