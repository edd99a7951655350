import random

import numpy as np
import pytest
import xxhash

from plumbline.llm import simhash
from plumbline.llm.components import connected

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def brute_fingerprint(text):
    w = (text or "").encode().lower().split()
    shingles = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [b" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps):
    """fps: doc_id -> fingerprint."""
    up = {d: d for d in fps}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in fps:
        for b in fps:
            if (fps[a] ^ fps[b]).bit_count() <= 2:
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return {d: root(d) for d in fps}


@pytest.mark.parametrize("text", ["", None, "  \t ", "One", "one TWO", "one two three", "a b c d a b c", "É é x\x0by z\x1cq", "w " * 500])
def test_fingerprint(text):
    assert simhash.fingerprint(None if text is None else text.encode()) == brute_fingerprint(text)


def near(random_, n):
    """Fingerprints in chains and clusters, and far ones."""
    out = []
    for _ in range(n):
        x = random_.getrandbits(64)
        out.append(x)
        for _ in range(random_.randrange(4)):
            x ^= 1 << random_.randrange(64)
            if random_.random() < 0.5:
                x ^= 1 << random_.randrange(64)
            out.append(x)
    return sorted(set(out))


@pytest.mark.parametrize("seed, cap", [(0, 1 << 18), (1, 40)])
def test_links_lose_nothing(spark, seed, cap):
    r = random.Random(seed)
    hot = r.getrandbits(64) & ~0xFFFF  # a third share their leading bits
    fps = near(r, 60) + sorted({hot | r.getrandbits(14) for _ in range(80)})
    fps = sorted(set(fps))
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    edges = simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long"), max_subtree=cap)
    roots = {row["node"]: row["root"] for row in connected(edges).collect()}
    want = brute_components({x: x & (1 << 64) - 1 for x in signed})
    for a in signed:
        for b in signed:
            assert (roots.get(a, a) == roots.get(b, b)) == (want[a] == want[b])


def test_traversal_visits_large_subtrees():
    r = np.random.default_rng(5)
    keys = np.unique(r.integers(0, 1 << 16, 3000).astype(np.uint64))
    got = set()
    simhash.trie_links(keys, [(0, len(keys))], 2, lambda i, j: got.update(zip(np.minimum(i, j).tolist(), np.maximum(i, j).tolist())))
    close = np.bitwise_count(keys[:, None] ^ keys[None, :]) <= 2
    assert got == {(i, j) for i, j in zip(*np.nonzero(close)) if i < j}


@pytest.mark.parametrize("budget", [0, 1, 2, 5])
def test_groups_are_traversed_side_by_side(budget):
    r = np.random.default_rng(budget)
    groups = [np.unique(r.integers(0, 1 << 63, n, dtype=np.uint64) >> np.uint64(r.integers(0, 60)) << np.uint64(r.integers(0, 4))) for n in r.integers(1, 40, 60)]
    keys = np.concatenate(groups)
    ends = np.cumsum([len(g) for g in groups])
    got: list[tuple[int, int]] = []
    simhash.trie_links(keys, np.column_stack((ends - [len(g) for g in groups], ends)), budget, lambda i, j: got.extend(zip(np.minimum(i, j).tolist(), np.maximum(i, j).tolist())))
    of = np.repeat(np.arange(len(groups)), [len(g) for g in groups])
    close = (np.bitwise_count(keys[:, None] ^ keys[None, :]) <= budget) & (of[:, None] == of[None, :])
    assert len(got) == len(set(got)) and set(got) == {(i, j) for i, j in zip(*np.nonzero(close)) if i < j}


def test_every_dealt_pair_is_reached_through_nodes(spark, monkeypatch):
    """Small groups, as ordinary data give them, are traversed too: a pair takes a visit of its root and of its leaves."""
    pairs = np.array([8, 9, 1 << 40, (1 << 40) + 1], np.uint64)
    seen = []
    assert simhash.trie_links(pairs, [(0, 2), (2, 4)], 2, lambda i, j: seen.append(len(i))) == 4 and sum(seen) == 2
    far = np.array([0, 7, 8, 15], np.uint64)  # below a budget of 0 only roots and their undivided children are visited
    assert simhash.trie_links(far, [(0, 4)], 0, lambda i, j: None) < 16


def test_subtrees_by_pieces_of_a_partition(spark, monkeypatch):
    r = random.Random(9)
    fps = near(r, 400)
    rows = sorted((1, x >> 56, x - (1 << 64) if x >> 63 else x) for x in fps)
    rows.sort(key=lambda t: (t[1], t[2] & (1 << 64) - 1))
    import pyarrow as pa

    batches = [pa.RecordBatch.from_arrays([pa.array([t[k] for t in rows[i : i + 50]], pa.int64()) for k in range(3)], ["trie", "key", "fp"]) for i in range(0, len(rows), 50)]
    whole = [b.to_pydict() for b in simhash._walk(2)(iter(batches))]
    monkeypatch.setattr(simhash, "ROWS_AT_ONCE", 60)
    parts = [b.to_pydict() for b in simhash._walk(2)(iter(batches))]
    assert len(parts) > 3 and sorted(zip(*(sum((p[c] for p in parts), []) for c in "uv"))) == sorted(zip(*(whole[0][c] for c in "uv")))


def test_documents(spark):
    rng = random.Random(3)
    base = " ".join(f"w{rng.randrange(500)}" for _ in range(300))
    rows = [(i, base, "en", "s", 1) for i in range(40)] + [(50, base + " x", "en", "s", 1), (60, None, None, None, None), (61, "", "en", "s", 1), (62, " \t", "en", "s", 1), (70, "quite other words here", "en", "s", 1), (70, "quite other words here", "en", "s", 1), (None, base, "en", "s", 1), (80, "x" * 200_000, "en", "s", 1)]
    df = spark.createDataFrame(rows, DOCS).selectExpr("*", "1 AS fp", "2 AS component_id", "'y' AS u")
    got = [(r["doc_id"], r["fingerprint"], r["component_id"]) for r in simhash.op2(df).collect()]
    want = brute_components({d: brute_fingerprint(t) for d, t, *_ in rows if d is not None})
    assert len(got) == len(rows)
    for d, f, c in got:
        text = next(t for x, t, *_ in rows if x == d)
        assert f == f"{brute_fingerprint(text):016x}" and c == (want[d] if d is not None else 0)
    kept = simhash.keep_one(df)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({c for c in want.values()}) and kept.columns == df.columns


def test_empty(spark):
    assert simhash.op2(spark.createDataFrame([], DOCS)).count() == 0


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(1000, 1001), (7, 7)], "u long, v long")
    got = {r["node"]: r["root"] for r in connected(edges).collect()}
    assert {got[i] for i in range(201)} == {0} and got[1001] == 1000
