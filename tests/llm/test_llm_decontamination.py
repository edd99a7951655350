import random

import numpy as np
import pytest

from plumbline.llm import decontaminate as d

DOCS = "doc_id long, text string, lang string, source string, n_chars long, item_id long"


def brute_tiles(item, doc, k):
    """Greedy string tiling by trying all starts."""
    free_i, free_d, covered = [True] * len(item), [True] * len(doc), 0
    while True:
        best = None
        for a in range(len(item)):
            for b in range(len(doc)):
                n = 0
                while a + n < len(item) and b + n < len(doc) and item[a + n] == doc[b + n] and free_i[a + n] and free_d[b + n]:
                    n += 1
                if n >= k and (best is None or n > best[0]):
                    best = (n, a, b)
        if best is None:
            return covered
        n, a, b = best
        free_i[a : a + n] = [False] * n
        free_d[b : b + n] = [False] * n
        covered += n


@pytest.mark.parametrize("seed", range(12))
def test_tiling(seed):
    r = random.Random(seed)
    item, doc = ([r.randrange(1, 4) for _ in range(n)] for n in (25, 60))
    got = d.tile(np.array(item), np.array(doc), 3)
    assert sum(t[2] for t in got) == brute_tiles(item, doc, 3)
    used = [x for a, b, m in got for x in range(b, b + m)]
    assert len(used) == len(set(used)) and all(item[a : a + m] == doc[b : b + m] for a, b, m in got)


def test_tiling_by_blocks(monkeypatch):
    r = random.Random(50)
    item, doc = ([r.randrange(1, 3) for _ in range(n)] for n in (40, 90))
    want = d.tile(np.array(item), np.array(doc), 3)
    monkeypatch.setattr(d, "AT_ONCE", 7)
    assert d.tile(np.array(item), np.array(doc), 3) == want and sum(t[2] for t in want) == brute_tiles(item, doc, 3)


def test_one_repeated_word():
    item, doc = np.ones(2_000, np.int64), np.ones(60_000, np.int64)
    assert d.tile(item, doc, 5) == [(0, 0, 2_000)]


def brute(texts, items, k, coverage):
    out = []
    for n, t in enumerate(texts):
        for i, x in enumerate(items):
            doc, item = d.words(t), d.words(x)
            if item:
                m = brute_tiles(item, doc, min(k, len(item)))
                if m >= coverage * len(item) - 1e-9:
                    out.append((n, i, len(item), m))
    return out


@pytest.mark.parametrize("seed", range(8))
def test_search_against_every_pair(seed, monkeypatch):
    """Few words, items with a common beginning, equal items, short items: coverage and matched words of every pair."""
    r = random.Random(seed)
    if seed % 2:
        monkeypatch.setattr(d, "AT_ONCE", 11)
    letters = [f"w{i}" for i in range(r.choice([2, 4, 30]))]
    some = lambda n: [r.choice(letters) for _ in range(n)]
    common = some(8)
    items = [" ".join(common * r.randrange(2) + some(r.randrange(1, 18))) for _ in range(12)] + ["", "w0", "w1 w0 w1", None]
    items += items[:2]
    texts = [" ".join(some(r.randrange(0, 30)) + d.words(r.choice(items)) + some(r.randrange(0, 9)) + d.words(r.choice(items))) for _ in range(14)] + [None, "", "Other words"]
    index = d.Index([(str(i), x) for i, x in enumerate(items)], 4, 0.8)
    assert sorted(x[:4] for x in index.find(texts)) == brute(texts, items, 4, 0.8)


def test_many_items_with_a_common_question():
    """Candidates are the documents' own items, not all that begin alike."""
    items = [(str(i), "which of the following words is right " + " ".join(f"a{i}b{j}" for j in range(40))) for i in range(4_000)]
    index = d.Index(items, 5, 0.8)
    texts = ["which of the following words is right about this " + items[i][1] for i in (5, 77)] + ["which of the following words is right then"] * 200
    looked = []
    inner = d.tile
    try:
        d.tile = lambda *a: looked.append(1) or inner(*a)
        assert sorted(x[:2] for x in index.find(texts)) == [(0, 5), (1, 77)]
    finally:
        d.tile = inner
    assert len(looked) == 2


def text(words):
    return " ".join(words)


@pytest.fixture(scope="module")
def made():
    r = random.Random(1)
    items = [[f"i{n}w{k}" for k in range(30)] for n in range(6)]
    fill = lambda n: [f"f{r.randrange(9999)}" for _ in range(n)]
    rows = [
        (0, text(fill(40) + items[0] + fill(9))),
        (1, text(items[1][15:] + fill(20) + items[1][:15])),  # in another order
        (2, text(fill(5) + items[2][:13] + fill(3)).upper()),  # too little
        (3, text(items[3]).upper().replace(" ", ", ")),
        (4, text(items[4][:12] + fill(1) + items[4][12:24] + fill(1) + items[4][24:])),
        (5, text(fill(100))),
        (6, None),
        (7, ""),
        (None, text(items[5])),
        (0, text(fill(40) + items[0] + fill(9))),
        (8, text(fill(60_000) + items[5])),
    ]
    bench = [(n, text(w)) for n, w in enumerate(items)] + [(50, "too short here"), (51, None), (0, text(items[0]))]
    return rows, bench


def frames(spark, made):
    rows, bench = made
    return spark.createDataFrame([(i, t, "en", "s", 1, 7) for i, t in rows], DOCS), spark.createDataFrame([(i, t, 1) for i, t in bench], "item_id long, text string, doc_id int")


@pytest.mark.parametrize("block", [2_000_000, 20])
def test_contaminated(spark, made, block):
    docs, bench = frames(spark, made)
    got = sorted(((r["doc_id"], r["item_id"]) for r in d.contaminated(docs, bench, block_words=block).collect()), key=str)
    assert got == sorted([(0, 0)] * 4 + [(1, 1), (3, 3), (4, 4), (None, 5), (8, 5)], key=str)
    clean = d.keep_clean(docs, bench, block_words=block)
    assert sorted(r["doc_id"] for r in clean.collect()) == [2, 5, 6, 7] and clean.columns == docs.columns


def test_figures_of_the_query(spark, made):
    rows, bench = made
    docs, items = frames(spark, made)
    got = sorted({(str(r["doc_id"]), r["item_id"], r["item_words"], r["matched_words"], r["coverage"]) for r in d.contaminated(docs, items).collect()})
    small = [(i, t) for i, t in rows if len(t or "") < 5_000]  # the slow version takes cubic time
    want = {(str(small[n][0]), bench[i][0], w, m, round(m / w, 6)) for n, i, w, m in brute([t for _, t in small], [t for _, t in bench], 5, 0.8)}
    assert got == sorted(want | {("8", 5, 30, 30, 1.0)})


def test_empty(spark, made):
    docs, bench = frames(spark, made)
    assert d.contaminated(docs.limit(0), bench).count() == 0 and d.contaminated(docs, bench.limit(0)).count() == 0
    assert d.keep_clean(docs, bench.limit(0)).count() == docs.count()
