"""Exact removal of repeated passages, by difference-cover anchors.

A window is WINDOW words in a row. COVER is a perfect difference set modulo PERIOD: for any two positions i and j there
is a shift d below PERIOD at which both i + d and j + d, modulo PERIOD, are in it. So two windows with the same words
share an anchor - ANCHOR = WINDOW - PERIOD + 1 words at a cover position - that starts at the same place in both.

1. Each text hashes its anchors, at cover positions only. Those found at two places are kept.
2. They extend: each window that holds a kept anchor, and no other, is hashed as a whole, by 128 bits. Those found at
   two places are repeated, and every repeated window is among them.
3. The words under repeated windows go.

Texts that equal each other are one place: they are counted apart, by a 128-bit hash of the text, so a group of copies
is looked at once in a task. A hash that a task has met at two places is known to repeat from then
on: the two rows leave under the hash, all others are dealt out by a hash of their own place. So a passage in a third of
all documents gives the task that its hash is dealt to two rows from each task that read documents.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import arrow_map, slices, written

WINDOW, PERIOD = 35, 21
COVER = (3, 6, 7, 12, 14)
ANCHOR = WINDOW - PERIOD + 1
#: Bits of the filter that keeps texts without a kept anchor out of step 2: a broadcast of a row of two longs for each 64
#: bits, 262,144 rows at most. With more texts than an eighth of the bits it would keep out few, so all texts are joined.
FILTER_BITS = 1 << 24
#: Hashes that a task remembers as known to repeat; beyond, more rows leave under their hash.
PROVEN = 1 << 20
#: Texts that a task remembers as looked at; beyond, a copy is looked at again.
SEEN = 200_000
_BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _hashed(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def _windows(h: np.ndarray, at: np.ndarray, width: int, base: np.uint64) -> np.ndarray:
    """Hashes of the windows of so many words that start at the positions at."""
    out = np.zeros(len(at), np.uint64)
    for j in range(width):
        out = out * base + h[at + j]
    return _mixed(out)


class _Proven:
    """Keys that this task has put out at two places."""

    def __init__(self, keys: int):
        self.keys = np.zeros((keys, 0), np.uint64)

    def holds(self, keys: list[np.ndarray]) -> np.ndarray:
        if not self.keys.shape[1]:
            return np.zeros(len(keys[0]), bool)
        at = np.minimum(np.searchsorted(self.keys[0], keys[0]), self.keys.shape[1] - 1)
        return np.all([own[at] == k for own, k in zip(self.keys, keys)], axis=0)

    def add(self, keys: list[np.ndarray]) -> None:
        if self.keys.shape[1] < PROVEN:
            all_ = np.concatenate((self.keys, np.stack(keys)), axis=1)
            self.keys = all_[:, np.unique(all_[0], return_index=True)[1]][:, :PROVEN]


def _put(keys: list[np.ndarray], t1: np.ndarray, t2: np.ndarray, pos: np.ndarray, proven: _Proven) -> pa.RecordBatch:
    """Rows of hashed places. Rows of a proven key, and of another all but two, get a key of their place and are marked as known."""
    order = np.lexsort((pos, t1, *keys[::-1]))
    keys, t1, t2, pos = [k[order] for k in keys], t1[order], t2[order], pos[order]
    known = proven.holds(keys)
    again = np.zeros(len(pos), bool)
    again[1:] = np.all([k[1:] == k[:-1] for k in keys], axis=0)
    proven.add([k[again & ~known] for k in keys])
    known[2:] |= again[2:] & again[1:-1]
    place = _mixed(t1[known].view(np.uint64) ^ _mixed(t2[known].view(np.uint64) + pos[known].astype(np.uint64)))
    for k in keys:
        k[known] = place
    return pa.RecordBatch.from_arrays([*(pa.array(k.view(np.int64)) for k in keys), pa.array(t1), pa.array(t2), pa.array(pos.astype(np.int32)), pa.array(known)], [*(f"k{i}" for i in range(len(keys))), "t1", "t2", "pos", "known"])


class _Texts:
    """Texts that a task has looked at."""

    def __init__(self):
        self.seen: set[tuple[int, int]] = set()

    def new(self, t1: np.ndarray, t2: np.ndarray) -> list[int]:
        """First row of each text of a slice that the task hasn't looked at; of very many texts it forgets the earlier ones."""
        if len(self.seen) > SEEN:
            self.seen.clear()
        rows = np.sort(np.unique(np.stack((t1, t2)), axis=1, return_index=True)[1])
        names = list(zip(t1[rows].tolist(), t2[rows].tolist()))
        found = [i for i, name in zip(rows.tolist(), names) if name not in self.seen]
        self.seen.update(names)
        return found


def anchors(texts: DataFrame) -> DataFrame:
    """(k0, t1, t2, pos, known) of the anchors of (t1, t2, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        proven, texts_ = _Proven(1), _Texts()
        for b in batches:
            for s in slices(b.column(2)):
                t1, t2 = (b.column(i)[s.start : s.stop].to_numpy() for i in (0, 1))
                rows = texts_.new(t1, t2)
                split = [x.split() for x in b.column(2)[s.start : s.stop].take(pa.array(rows)).cast(pa.binary()).to_pylist()]
                n = np.fromiter(map(len, split), np.int64, len(split))
                h = _hashed([w for ws in split for w in ws])
                begin = np.cumsum(n) - n
                pos = np.arange(len(h)) - np.repeat(begin, n)
                at = np.flatnonzero(np.isin(pos % PERIOD, COVER) & (pos + ANCHOR <= np.repeat(n, n)) & np.repeat(n >= WINDOW, n))
                of = np.array(rows, np.int64)[np.searchsorted(begin + n, at, "right")]
                if len(at):
                    yield _put([_windows(h, at, ANCHOR, _BASES[0])], t1[of], t2[of], pos[at], proven)

    return arrow_map(texts, run, "k0 long, t1 long, t2 long, pos int, known boolean")


def candidate_windows(texts: DataFrame) -> DataFrame:
    """(k0, k1, t1, t2, pos, known) of the windows of (t1, t2, text, at) that hold an anchor at a position of at."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        proven, texts_ = _Proven(2), _Texts()
        for b in batches:
            for s in slices(b.column(2)):
                t1, t2 = (b.column(i)[s.start : s.stop].to_numpy() for i in (0, 1))
                h, start, of, base = [], [], [], 0
                for i in texts_.new(t1, t2):
                    own = _hashed(b.column(2)[s.start + i].as_py().encode().split())
                    kept = np.zeros(len(own) + 1, np.int64)
                    at = np.unique(b.column(3)[s.start + i].values.to_numpy())
                    np.add.at(kept, np.maximum(at - (WINDOW - ANCHOR), 0), 1)
                    np.add.at(kept, at + 1, -1)
                    found = np.flatnonzero(np.cumsum(kept)[: len(own) - WINDOW + 1] > 0)
                    h.append(own)
                    start.append(np.stack((found + base, found)))
                    of.append(np.full(len(found), i))
                    base += len(own)
                if not start:
                    continue
                start, of = np.concatenate(start, axis=1), np.concatenate(of)
                if len(of):
                    h = np.concatenate(h)
                    yield _put([_windows(h, start[0], WINDOW, _BASES[0]), _windows(_mixed(h), start[0], WINDOW, _BASES[1])], t1[of], t2[of], start[1], proven)

    return arrow_map(texts, run, "k0 long, k1 long, t1 long, t2 long, pos int, known boolean")


def _repeated(places: DataFrame, keys: list[str]) -> DataFrame:
    """(t1, t2, at): positions of the places that are known to repeat, or whose key is found at two places."""
    place = places.withColumn("place", F.xxhash64("t1", "t2", "pos"))
    by = Window.partitionBy(*keys)
    dup = place.select("t1", "t2", "pos", "known", (F.min("place").over(by) != F.max("place").over(by)).alias("twice")).where("known OR twice")
    return dup.groupBy("t1", "t2").agg(F.collect_set("pos").alias("at"))


def _maybe(docs: DataFrame, texts: DataFrame) -> DataFrame:
    """docs without most of the rows whose text isn't in texts (a written table); the filter is of bounded size."""
    if texts.count() > FILTER_BITS // 8:
        return docs
    slot = F.pmod("t1", F.lit(FILTER_BITS))
    bits = texts.select(slot.alias("s")).groupBy(F.shiftright("s", 6).alias("_word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(s & 63 as int))")).alias("_bits"))
    own = docs.withColumn("_s", slot).withColumn("_w", F.shiftright("_s", 6))
    return own.join(F.broadcast(bits), own["_w"] == bits["_word"]).where(F.expr("shiftright(_bits, cast(_s & 63 as int)) & 1L = 1L")).drop("_s", "_w", "_word", "_bits")


def _cut(texts: DataFrame) -> DataFrame:
    """(t1, t2, removed, kept_sha256) of (t1, t2, text, at), at the starts of repeated windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in slices(b.column(2)):
                removed, shas = [], []
                for i in range(s.start, s.stop):
                    words = b.column(2)[i].as_py().encode().split()
                    kept, n = kept_words(words, b.column(3)[i].values.to_numpy())
                    removed.append(n)
                    shas.append(hashlib.sha256(b" ".join(kept)).hexdigest())
                yield pa.RecordBatch.from_arrays([b.column(0)[s.start : s.stop], b.column(1)[s.start : s.stop], pa.array(removed, pa.int64()), pa.array(shas, pa.string())], ["t1", "t2", "removed", "kept_sha256"])

    return arrow_map(texts, run, "t1 long, t2 long, removed long, kept_sha256 string")


def kept_words(words: list[bytes], starts: np.ndarray) -> tuple[list[bytes], int]:
    """The words under no window that starts at one of starts, and the number of the others."""
    under = np.zeros(len(words) + 1, np.int64)
    starts = np.unique(starts)
    np.add.at(under, starts, 1)
    np.add.at(under, starts + WINDOW, -1)
    gone = np.cumsum(under)[:-1] > 0
    return [w for w, g in zip(words, gone) if not g], int(gone.sum())


def _whole(docs: DataFrame) -> DataFrame:
    """(doc_id, t1, t2, n_words, whole_sha256) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in slices(b.column(3)):
                split = [x.split() for x in b.column(3)[s.start : s.stop].cast(pa.binary()).to_pylist()]
                own = b.slice(s.start, s.stop - s.start)
                yield pa.RecordBatch.from_arrays([*own.columns[:3], pa.array(list(map(len, split)), pa.int64()), pa.array([hashlib.sha256(b" ".join(x)).hexdigest() for x in split])], ["doc_id", "t1", "t2", "n_words", "whole_sha256"])

    return arrow_map(docs.select("doc_id", "t1", "t2", "text"), run, "doc_id long, t1 long, t2 long, n_words long, whole_sha256 string")


def repeated_windows(docs: DataFrame) -> DataFrame:
    """(t1, t2, text, at) of each text with windows that start in another text or elsewhere in it; copies repeat.

    docs: t1, t2, text. A text's own copies are no other text here.
    """
    kept = written(_repeated(anchors(docs.select("t1", "t2", "text")), ["k0"]), "anchors")
    texts = written(_maybe(docs.select("t1", "t2", "text"), kept).join(kept, ["t1", "t2"]).select("t1", "t2", "text", "at"), "anchored")
    starts = written(_repeated(candidate_windows(texts), ["k0", "k1"]), "windows")
    return texts.drop("at").join(starts, ["t1", "t2"]).select("t1", "t2", "text", "at")


def remove_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of every row of docs; needs doc_id and text.

    A null text has no words; with no words, or none left, kept_sha256 is that of the empty string. Rows that repeat a
    text, with the same doc_id or not, are copies of each other: with WINDOW words or more, all their words go. Texts
    of fewer words stay whole. Texts of any length are read whole. Rows without a doc_id keep a row. Extra columns,
    whatever their names, play no part. An empty table gives an empty result.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(1), text).alias("t2"), text.alias("text"))
    whole = written(_whole(rows), "whole-texts")
    copied = whole.groupBy("t1", "t2").agg(F.count("*").alias("copies"), F.first("n_words").alias("n")).where((F.col("copies") > 1) & (F.col("n") >= WINDOW)).select("t1", "t2", F.col("n").alias("removed"), F.lit(hashlib.sha256().hexdigest()).alias("kept_sha256"))
    cut = _cut(repeated_windows(rows)).dropDuplicates(["t1", "t2"]).join(copied, ["t1", "t2"], "left_anti")
    changed = written(cut.unionByName(copied), "changed-texts")
    return whole.join(changed, ["t1", "t2"], "left").select("doc_id", "n_words", F.coalesce("removed", F.lit(0).cast("long")).alias("n_removed"), F.coalesce("kept_sha256", "whole_sha256").alias("kept_sha256"))
