"""Language identification by a linear-chain conditional random field over words.

A word's features are its lexicon entry, its affixes and its character n-grams, hashed into one weight table; labels
are the languages, with learned start weights and transitions, so that the words of a text that changes its language
are labelled run by run. Forward-backward gives each word's label probabilities; a text gets the language with the
largest mean probability over its words with letters, and that mean is its score.

The chain is not walked word by word. Texts are cut in runs of RUN words; the product of each run's matrices carries
the forward and backward messages from run to run, and all runs are then walked side by side. The result is that of
the plain recursion. A long text is walked by blocks of words: the products of its runs first, then, with the messages
between them, each block once more, so memory is bounded by a block and a matrix a run.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.common import arrow_map, give_back, slices

RUN = 64
#: Rows of the weight table; words whose scores a worker remembers, and their characters in total.
HASHED, REMEMBERED, REMEMBERED_CHARS = 1 << 18, 200_000, 8_000_000
#: Characters of texts labelled at once; a longer text goes by blocks of so many. Bytes of a word hashed at once.
BLOCK, WORD_BLOCK = 1_000_000, 1 << 20
_SPACE = re.compile(r"\s")
UNDETERMINED = "und"


def cleaned(word: str) -> bytes:
    """What features look at: the lower-cased word without outer punctuation; empty if it has no letter."""
    w = word.lower().strip(".,;:!?\"'()[]{}<>|*_-#")
    return w.encode() if w.isalpha() or any(map(str.isalpha, w)) else b""


def features(words: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Hashed features of cleaned words, as parts (features end to end, how many each word has).

    The lexicon entry, then n-grams of 2, 3 and 4 bytes of the word between two marks; those that hold a mark are its affixes.
    """
    some = np.fromiter(map(bool, words), bool, len(words))
    entry = np.fromiter((xxhash.xxh32_intdigest(w) & (HASHED - 1) for w in words if w), np.int64, int(some.sum()))
    parts = [(entry, some.astype(np.int64))]
    b = np.frombuffer(b"".join(b"\2%b\3" % w for w in words if w), np.uint8).astype(np.uint64)
    n = np.zeros(len(words), np.int64)
    n[some] = np.fromiter((len(w) + 2 for w in words if w), np.int64, len(entry))
    left = np.repeat(np.cumsum(n), n) - np.arange(len(b))  # bytes from here to the end of the word
    for k in (2, 3, 4):
        at = np.flatnonzero(left >= k)
        h = np.full(len(at), k, np.uint64)
        for j in range(k):
            h = (h ^ b[at + j]) * np.uint64(0x100000001B3)
        h ^= h >> np.uint64(21)
        parts.append(((h & np.uint64(HASHED - 1)).astype(np.int64), np.where(some, np.maximum(n - k + 1, 0), 0)))
    return parts


def _ngrams(b: np.ndarray, k: int) -> np.ndarray:
    """Hashed features of all windows of k bytes."""
    h = np.full(max(len(b) - k + 1, 0), k, np.uint64)
    for j in range(k):
        h = (h ^ b[j : j + len(h)]) * np.uint64(0x100000001B3)
    return ((h ^ h >> np.uint64(21)) & np.uint64(HASHED - 1)).astype(np.int64)


def _scores(words: list[bytes], weights: np.ndarray) -> np.ndarray:
    """Sums of the weights of cleaned words' features over the root of their number."""
    out, total = np.zeros((len(words), weights.shape[1])), np.zeros(len(words), np.int64)
    for flat, n in features([w if len(w) <= WORD_BLOCK else b"" for w in words]):
        some = n > 0
        if some.any():
            out[some] += np.add.reduceat(weights[flat], (np.cumsum(n) - n)[some], axis=0)
            total += n
    for i in (i for i, w in enumerate(words) if len(w) > WORD_BLOCK):  # a very long word by blocks
        out[i], total[i] = weights[xxhash.xxh32_intdigest(words[i]) & (HASHED - 1)], 1
        b = np.frombuffer(b"\2%b\3" % words[i], np.uint8)
        for k in (2, 3, 4):
            for at in range(0, len(b) - k + 1, WORD_BLOCK):
                h = _ngrams(b[at : at + WORD_BLOCK + k - 1].astype(np.uint64), k)
                out[i] += weights[h].sum(axis=0, dtype=np.float64)
                total[i] += len(h)
    return out / np.sqrt(np.maximum(total, 1))[:, None]


def blocks_of(text: str) -> Iterator[list[str]]:
    """The words of a text by blocks of about BLOCK characters; each but the last has whole runs of words."""
    at, held = 0, []
    while at < len(text) or not at:
        m = _SPACE.search(text, at + BLOCK) if at + BLOCK < len(text) else None
        to = m.start() if m else len(text)
        held += text[at:to].split()
        at = to
        n = len(held) if at >= len(text) else len(held) // RUN * RUN
        yield held[:n]
        held = held[n:]
        if at >= len(text):
            return


def runs_of(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The runs of texts laid end to end: index of the word of each step (-1 beyond the end), text, number in the text."""
    per = -(-lengths // RUN)
    text = np.repeat(np.arange(len(lengths)), per)
    number = np.arange(len(text)) - np.repeat(np.cumsum(per) - per, per)
    begin = (np.cumsum(lengths) - lengths)[text] + number * RUN
    left = lengths[text] - number * RUN
    step = np.arange(RUN)
    return np.where(step < left[:, None], begin[:, None] + step, -1), text, number


class _Runs:
    """The runs of scored words: texts laid end to end, each from its first word on or, carried, from inside a text."""

    def __init__(self, scores: np.ndarray, lengths: np.ndarray, start: np.ndarray, trans: np.ndarray, carried: bool = False):
        at, self.text, self.number = runs_of(lengths)
        self.k, self.n = scores.shape[1], len(at)
        self.top = scores.max(axis=1, keepdims=True) if len(scores) else np.zeros((0, 1))
        self.emit = np.ones((self.n, RUN, self.k))
        self.real = at >= 0
        self.emit[self.real] = np.exp(scores - self.top)[at[self.real]]
        self.a = np.exp(trans)
        self.begins = (self.number == 0) & (not carried)
        self.first = np.where(self.begins[:, None, None], np.exp(start)[None, None, :], self.a[None])  # into the first word of a run

    def products(self) -> np.ndarray:
        """The product of each run's matrices, scaled."""
        product = self.first * self.emit[:, 0, None, :]
        for t in range(1, RUN):
            live = self.real[:, t]
            if not live.any():
                break
            step = (product.reshape(-1, self.k) @ self.a).reshape(self.n, self.k, self.k) * self.emit[:, t, None, :]
            product = np.where(live[:, None, None], step, product)
            if t % 8 == 0:
                product /= product.sum(axis=(1, 2), keepdims=True)
        return product / product.sum(axis=(1, 2), keepdims=True)

    def walk(self, into: np.ndarray, out: np.ndarray, moves: bool) -> tuple[np.ndarray, float, np.ndarray]:
        """Forward-backward within the runs, given the messages from before and from behind each."""
        a, emit, real, k, runs = self.a, self.emit, self.real, self.k, self.n
        alpha, norm = np.zeros((runs, RUN, k)), np.ones((runs, RUN))
        for t in range(RUN):
            before = np.einsum("ri,rij->rj", into, self.first) if t == 0 else alpha[:, t - 1] @ a
            m = before * emit[:, t]
            total = m.sum(axis=1)
            live = real[:, t]
            alpha[:, t] = np.where(live[:, None], m / total[:, None], 0 if t == 0 else alpha[:, t - 1])
            norm[:, t] = np.where(live, total, 1)
        beta, expected = out, np.zeros((k, k))
        gamma = np.zeros((runs, RUN, k))
        for t in range(RUN - 1, -1, -1):
            live = real[:, t]
            g = alpha[:, t] * beta
            g /= g.sum(axis=1, keepdims=True)
            gamma[:, t] = g
            back = emit[:, t] * beta
            inner = live if t else live & ~self.begins
            if moves and inner.any():
                prev = alpha[inner, t - 1] if t else into[inner]
                pair = prev[:, :, None] * a[None] * back[inner][:, None, :]
                expected += (pair / pair.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
            if t:
                m = back @ a.T
                beta = np.where(live[:, None], m / m.sum(axis=1, keepdims=True), beta)
        return gamma[real], float(np.log(norm[real]).sum() + self.top.sum()), expected


def messages(product: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What each run gets from the runs before it in its text, and from those behind; number: of a run in its text."""
    runs, k = product.shape[:2]
    into, out = np.full((runs, k), 1.0 / k), np.ones((runs, k))
    order = np.argsort(number, kind="stable")
    edges = np.searchsorted(number[order], np.arange(number.max() + 2))
    for n in range(1, number.max() + 1):  # over the runs of the longest text
        own = order[edges[n] : edges[n + 1]]
        m = np.einsum("ri,rij->rj", into[own - 1], product[own - 1])
        into[own] = m / m.sum(axis=1, keepdims=True)
    for n in range(number.max(), 0, -1):
        own = order[edges[n] : edges[n + 1]]
        m = np.einsum("rij,rj->ri", product[own], out[own])
        out[own - 1] = m / m.sum(axis=1, keepdims=True)
    return into, out


def marginals(scores: np.ndarray, lengths: np.ndarray, start: np.ndarray, trans: np.ndarray, moves: bool = False) -> tuple[np.ndarray, float, np.ndarray]:
    """Forward-backward over texts laid end to end: each word's label probabilities, the log of the product of the
    texts' partition functions, and, if moves are asked for, the expected number of each transition."""
    runs = _Runs(scores, lengths, start, trans)
    if not runs.n:
        return np.zeros((0, runs.k)), 0.0, np.zeros((runs.k, runs.k))
    return runs.walk(*messages(runs.products(), runs.number), moves)


class Model:
    """labels, the weights of the features that training saw (rows: of each hashed feature its row in weights, 0 if it
    wasn't seen), and the weights of starts and transitions."""

    def __init__(self, labels: list[str], weights: np.ndarray, rows: np.ndarray, start: np.ndarray, trans: np.ndarray):
        self.labels, self.start, self.trans = labels, start, trans
        # The last column says whether a feature was seen.
        self.weights, self.rows = np.column_stack((weights, np.arange(len(weights)) > 0)).astype(np.float32), rows
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.chars, self.table = 0, np.zeros((0, len(self.labels) + 2))

    def words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Label scores of each word, and its evidence: the share of its features that training saw, -1 without a letter."""
        if len(self.known) > REMEMBERED or self.chars > REMEMBERED_CHARS:
            self._forget()
        rows = list(map(self.known.get, words))
        fresh = list(dict.fromkeys(w for w, r in zip(words, rows) if r is None))
        if fresh:
            clean = list(map(cleaned, fresh))
            self.known.update(zip(fresh, range(len(self.table), len(self.table) + len(fresh))))
            self.chars += sum(map(len, fresh))
            number = np.array([1 + sum(max(len(w) + 3 - k, 0) for k in (2, 3, 4)) if w else 1 for w in clean])
            found = _scores(clean, _Rows(self.weights, self.rows))
            share = np.where(np.fromiter(map(bool, clean), bool, len(clean)), found[:, -1] / np.sqrt(number), -1)
            self.table = np.concatenate((self.table, np.column_stack((found[:, :-1], share, number))))
            rows = map(self.known.__getitem__, words)
        own = self.table[np.fromiter(rows, np.int64, len(words))]
        return own[:, :-2], own[:, -2]

    def label(self, texts: list[str | None]) -> tuple[list[str], list[float], list[list[tuple[int, int, str]]]]:
        """Language, score and runs (first word, end, language) of each whole text."""
        return self.judged(texts)[:3]

    def judged(self, texts: list[str | None]) -> tuple[list[str], list[float], list[list[tuple[int, int, str]]], list[float]]:
        """Language, score, runs (first word, end, language) and evidence of each whole text.

        Evidence is the mean of that of its words with letters.
        """
        out = [self._long(t) if t and len(t) > BLOCK else None for t in texts]
        split = [(t or "").split() if o is None else [] for t, o in zip(texts, out)]
        lengths = np.fromiter(map(len, split), np.int64, len(split))
        scores, evidence = self.words([w for ws in split for w in ws])
        gamma, _, _ = marginals(scores, lengths, self.start, self.trans)
        ends = np.cumsum(lengths)
        for i, (b, e) in enumerate(zip((ends - lengths).tolist(), ends.tolist())):
            if out[i] is None:
                out[i] = self._result([(gamma[b:e], evidence[b:e])])
        return tuple(map(list, zip(*out))) if out else ([], [], [], [])

    def _result(self, parts) -> tuple[str, float, list[tuple[int, int, str]], float]:
        """What the words' label probabilities and evidence, by blocks, say of a text."""
        total, n, shown, before, cuts, last = np.zeros(len(self.labels)), 0, 0.0, 0, [], -1
        for gamma, evidence in parts:
            own = evidence >= 0
            total += gamma[own].sum(axis=0)
            n += int(own.sum())
            shown += float(evidence[own].sum())
            best = gamma.argmax(axis=1)
            for c in np.flatnonzero(np.diff(np.concatenate(([last], best)))).tolist():
                cuts.append((before + c, int(best[c])))
            before, last = before + len(best), int(best[-1]) if len(best) else last
        if not n:
            return UNDETERMINED, 0.0, [], 0.0
        edges = [*(c for c, _ in cuts[1:]), before]
        score = float(min(max(total.max() / n, 0.0), 1.0))
        return self.labels[int(total.argmax())], score, [(b, e, self.labels[y]) for (b, y), e in zip(cuts, edges)], shown / n

    def _long(self, text: str) -> tuple[str, float, list[tuple[int, int, str]], float]:
        """One text by blocks of words: a first pass for the messages between runs, a second for the labels."""

        def runs() -> Iterator[tuple[_Runs, np.ndarray]]:
            for i, ws in enumerate(blocks_of(text)):
                scores, evidence = self.words(ws)
                yield _Runs(scores, np.array([len(ws)]), self.start, self.trans, carried=i > 0), evidence

        products = np.concatenate([r.products() for r, _ in runs() if r.n] or [np.zeros((0, len(self.labels), len(self.labels)))])
        if not len(products):
            return self._result([])
        into, out = messages(products, np.arange(len(products)))

        def parts() -> Iterator[tuple[np.ndarray, np.ndarray]]:
            at = 0
            for r, evidence in runs():
                if r.n:
                    yield r.walk(into[at : at + r.n], out[at : at + r.n], False)[0], evidence
                    at += r.n

        return self._result(parts())


class _Rows:
    """The weights of hashed features, of which only those seen are held."""

    def __init__(self, weights: np.ndarray, rows: np.ndarray):
        self.weights, self.rows, self.shape = weights, rows, (len(rows), weights.shape[1])

    def __getitem__(self, hashed):
        return self.weights[self.rows[hashed]]


def train(texts: list[str], langs: list[str], *, steps: int = 40, rate: float = 0.5, l2: float = 1e-5, seed: int = 0) -> Model:
    """Fits a model by AdaGrad on the conditional log-likelihood.

    The texts give sequences of RUN words; every third one is spliced from pieces of two texts, which
    teaches the transitions that a language change is possible and rare.
    """
    labels = sorted(set(langs))
    k, number = len(labels), {x: i for i, x in enumerate(labels)}
    random = np.random.default_rng(seed)
    split = [(t.split(), number[x]) for t, x in zip(texts, langs)]
    pieces = [(ws[i : i + RUN], y) for ws, y in split for i in range(0, len(ws), RUN)]
    sequences: list[tuple[list[str], list[int]]] = []
    for i, (ws, y) in enumerate(pieces):
        if i % 3 == 2:
            other, z = pieces[int(random.integers(len(pieces)))]
            cut = int(random.integers(1, RUN))
            ws, ys = ws[:cut] + other[cut:], [y] * len(ws[:cut]) + [z] * len(other[cut:])
        else:
            ys = [y] * len(ws)
        if ws:
            sequences.append((ws, ys))
    words = [w for ws, _ in sequences for w in ws]
    vocabulary = list(dict.fromkeys(words))
    row = {w: i for i, w in enumerate(vocabulary)}
    at = np.fromiter((row[w] for w in words), np.int64, len(words))
    gold = np.eye(k)[np.fromiter((y for _, ys in sequences for y in ys), np.int64, len(words))]
    lengths = np.array([len(ws) for ws, _ in sequences], np.int64)
    firsts = np.cumsum(lengths) - lengths
    inner = np.ones(len(words), bool)
    inner[firsts] = False
    y = gold.argmax(axis=1) if len(words) else np.zeros(0, int)
    moves = np.zeros((k, k))
    np.add.at(moves, (y[:-1][inner[1:]], y[1:][inner[1:]]), 1)
    parts = features(list(map(cleaned, vocabulary)))
    flat = np.concatenate([f for f, _ in parts])
    owner = np.concatenate([np.repeat(np.arange(len(vocabulary)), n) for _, n in parts])
    scale = 1 / np.sqrt(np.maximum(sum(n for _, n in parts), 1))
    used, flat = np.unique(flat, return_inverse=True)
    weights, start, trans = np.zeros((len(used), k)), np.zeros(k), np.zeros((k, k))
    sums = [np.full_like(p, 1e-8) for p in (weights, start, trans)]
    for _ in range(steps if len(words) else 0):
        scores = np.column_stack([np.bincount(owner, weights[flat, c], len(vocabulary)) for c in range(k)]) * scale[:, None]
        gamma, _, expected = marginals(scores[at], lengths, start, trans, moves=True)
        rest = (gold - gamma) / len(words)
        by_word = np.column_stack([np.bincount(at, rest[:, c], len(vocabulary)) for c in range(k)]) * scale[:, None]
        by_feature = np.column_stack([np.bincount(flat, by_word[owner, c], len(used)) for c in range(k)])
        for p, s, g in zip((weights, start, trans), sums, (by_feature - l2 * weights / len(used), rest[firsts].sum(axis=0), (moves - expected) / len(words))):
            s += g * g
            p += rate * g / np.sqrt(s)
    rows = np.zeros(HASHED, np.int32)
    rows[used] = np.arange(1, len(used) + 1)
    return Model(labels, np.concatenate((np.zeros((1, k)), weights)), rows, start, trans)


def held_out(doc_id: str = "doc_id"):
    """Rows that training never sees: crc32 of doc_id as text leaves 2 modulo 4."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, *, per_language: int = 150, rows: int = 6_000, chars: int = 8_000_000) -> Model:
    """A model of every language among the labels, from a bounded sample of the labelled rows.

    Only rows with a text, a doc_id and a lang that aren't held out count; of rows that share a doc_id and a lang, one.
    Of each language per_language rows are taken, the first by a hash of doc_id - fewer if there are so many languages
    that these would be more than rows (one at least) - and of each text at most its even share of chars characters.
    So the driver gets rows rows and chars characters, or one row a language if these are more. Everything else reads
    whole texts. Extra columns, whatever their names, play no part; without labels no language is learned.
    """
    text = F.col("text").cast("string")
    labelled = docs.where(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", F.col("lang").cast("string").alias("lang"), text.alias("text"), F.xxhash64(text).alias("mark"))
    languages = labelled.agg(F.count_distinct("lang")).first()[0]
    take = max(1, min(per_language, rows // max(languages, 1)))
    by = Window.partitionBy("lang").orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id")
    ids = labelled.groupBy("lang", "doc_id").agg(F.min("mark").alias("mark"))
    chosen = ids.withColumn("n", F.row_number().over(by)).where(F.col("n") <= take).select("lang", "doc_id", "mark")
    passage = F.substring("text", 1, max(1, chars // (take * max(languages, 1)))).alias("text")
    found = labelled.join(F.broadcast(chosen), ["lang", "doc_id", "mark"]).select("lang", "doc_id", passage).groupBy("lang", "doc_id").agg(F.min("text").alias("text")).collect()
    found.sort(key=lambda r: (r["lang"], r["doc_id"]))
    model = train([r["text"] for r in found], [r["lang"] for r in found])
    del found
    give_back()  # the driver goes on with other work
    return model


RUNS = T.ArrayType(T.StructType([T.StructField("first", T.LongType()), T.StructField("end", T.LongType()), T.StructField("lang", T.StringType())]))


def predict(docs: DataFrame, model: Model, names: tuple[str, str, str, str] = ("lang_pred", "lang_score", "lang_runs", "lang_evidence")) -> DataFrame:
    """docs with a language, its score, the runs (array of first word, end, lang) and the evidence under these names.

    Only the text is looked at, the whole of it. A null text, or one without a letter, is `und` with score and evidence
    0 and no runs; with no learned language all are. Rows stay in their task. An empty table stays empty.
    """
    at = docs.columns.index("text")
    sent = docs.sparkSession.sparkContext.broadcast((model.labels, model.weights[:, :-1], model.rows, model.start, model.trans))
    kept: list[Model] = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not kept:
            kept.append(Model(*sent.value))
        for b in batches:
            for s in slices(b.column(at), BLOCK):
                part = b.slice(s.start, s.stop - s.start)
                texts = part.column(at).to_pylist()
                if kept[0].labels:
                    langs, scores, runs, evidence = kept[0].judged(texts)
                else:
                    langs, scores, runs, evidence = [UNDETERMINED] * len(texts), [0.0] * len(texts), [[] for _ in texts], [0.0] * len(texts)
                kind = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64()), ("lang", pa.string())]))
                runs = pa.array([[{"first": x, "end": y, "lang": z} for x, y, z in r] for r in runs], kind)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64()), runs, pa.array(evidence, pa.float64())], [*part.schema.names, *names])

    schema = T.StructType([*docs.schema, T.StructField(names[0], T.StringType()), T.StructField(names[1], T.DoubleType()), T.StructField(names[2], RUNS), T.StructField(names[3], T.DoubleType())])
    return arrow_map(docs, run, schema)


def op10(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row of docs; needs doc_id, text and lang.

    Rows without a doc_id are predicted and never learned from; repeated rows give a row each.
    """
    rows = predict(docs.select("doc_id", F.col("text").cast("string").alias("text")), fit(docs))
    return rows.select("doc_id", held_out().alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))


def keep_languages(docs: DataFrame, *, min_evidence: float = 0.5) -> DataFrame:
    """docs whose text shows a language: letters, and words made as those of the learned languages are.

    A text goes if it is `und` (null, empty, without a letter) or if the mean share of its words' features that training
    saw is below min_evidence, as in a script that no label has. A text in several languages stays, and so does a short
    one whose words several of them share. Columns stay as they are, whatever their names; rows without a doc_id and
    repeated rows are judged like any other.
    """
    names = tuple("lang_" + x + "_" * (1 + max(map(len, docs.columns))) for x in ("pred", "score", "runs", "evidence"))  # longer than any other
    return predict(docs, fit(docs), names).where((F.col(names[0]) != UNDETERMINED) & (F.col(names[3]) >= min_evidence)).drop(*names)
