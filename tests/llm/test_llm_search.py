import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from plumbline.llm import search

DOCS = "doc_id long, text string, lang string, item_id long, score long, rank int"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, k=10):
    """All scores by the definition."""
    tf = [Counter(terms(t)) for _, t in docs]
    documents, total = sum(1 for x in tf if x), sum(x.total() for x in tf)
    df = Counter(t for x in tf for t in x)
    out = []
    for item, text in {x for x in items if x[1] is not None}:
        scores = []
        for (doc, _), x in zip(docs, tf):
            if x:
                m = 25 + (75 * x.total() * documents) // total
                s = sum(math.floor(1000 * math.log((2 * documents + 2) / (2 * df[t] + 1))) * (1_000_000_000 * x[t] // (1000 * x[t] + 8 * m)) for t in terms(text) if x[t])
                if s > 0:
                    scores.append((-s, doc is None, doc or 0, doc))
        out += [(item, n, d, -s) for n, (s, _, _, d) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def rows():
    r = random.Random(1)
    words = [f"w{i}" for i in range(60)] + ["É", "é", "Straße", "x1", "A", "a"]
    docs = [(i, " ".join(r.choice(words[: r.randrange(2, 66)]) for _ in range(r.randrange(1, 60)))) for i in range(300)]
    docs += [(None, "w1 w2 w3"), (None, None), (400, ""), (401, " \t..."), (5, docs[5][1]), (5, "w1"), (402, "W1,w2;W3-É"), (403, "w59 " * 70_000 + "w7")] + [(500 + i, "w1 w2 w3") for i in range(40)]
    items = [(i, " ".join(r.choice(words) for _ in range(r.randrange(1, 12)))) for i in range(25)] + [(30, None), (31, "unknown"), (32, ""), (None, "w1 É"), (3, "w4 w4 w5"), (3, "w4 w4 w5"), (33, "w1 w2 w3")]
    return docs, items


@pytest.mark.parametrize("shard, block", [(search.SHARD_BYTES, search.BLOCK_BYTES), (2_000, 300)])
def test_against_all_scores(spark, rows, shard, block):
    docs, items = rows
    df = spark.createDataFrame([(*x, None, 7, 8, 9) for x in docs], DOCS).repartition(3)
    asked = spark.createDataFrame([(*x, 1) for x in items], "item_id long, text string, doc_id long")
    got = search.search(df, asked, shard_bytes=shard, block_bytes=block)
    assert sorted(map(tuple, got.select("item_id", "rank", "doc_id", "score").collect()), key=str) == brute(docs, items)


def test_shards_skip_postings():
    """With a score to beat, common terms are probed for few documents only, and the result is that of all postings."""
    r = random.Random(2)
    known = [Counter({0: 1, 1: 1 + r.randrange(3), **({2: 1} if i % 97 == 0 else {})}) for i in range(5_000)]
    shard = search.Shard([x.total() for x in known], known, 3, 5_000, sum(x.total() for x in known))
    weight, query = np.array([1, 400, 6_000]), [(0, 1), (1, 1), (2, 2)]
    docs, score, every = shard.search(query, weight, 1)
    least = int(np.sort(score)[-10])
    few, best, looked = shard.search(query, weight, least)
    assert sorted(best.tolist()) == sorted(score[score >= least].tolist()) and set(few.tolist()) <= set(docs.tolist())
    assert looked < every / 20


def test_ties_by_doc_id():
    best = search.Best(3)
    best.add(np.array([5, 5, 9]), np.array([8, 0, 2]), np.array([False, True, False]))
    assert best.least == 5
    best.add(np.array([5, 5]), np.array([4, 7]), np.array([False, False]))
    assert best.doc.tolist() == [2, 4, 7] and best.score.tolist() == [9, 5, 5]


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert search.op11(docs.limit(0), items).count() == 0 and search.op11(docs, items.limit(0)).count() == 0
