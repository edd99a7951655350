import hashlib
import random

import pytest

from plumbline.llm import substrings as s

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def brute(rows):
    words = [(t or "").encode().split() for _, t, *_ in rows]
    seen = {}
    for w in words:
        for i in range(len(w) - 34):
            key = tuple(w[i : i + 35])
            seen[key] = seen.get(key, 0) + 1
    out = []
    for (d, *_), w in zip(rows, words):
        gone = set()
        for i in range(len(w) - 34):
            if seen[tuple(w[i : i + 35])] > 1:
                gone.update(range(i, i + 35))
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def test_cover_has_every_difference():
    assert {(a - b) % s.PERIOD for a in s.COVER for b in s.COVER} == set(range(s.PERIOD))


@pytest.fixture(scope="module")
def rows():
    r = random.Random(4)
    fresh = lambda n: [f"v{r.randrange(10**6)}" for _ in range(n)]
    shared = [fresh(n) for n in (34, 35, 36, 60, 90)]
    out = []
    for i in range(60):
        w = fresh(r.randrange(0, 60))
        for _ in range(r.randrange(3)):
            w += r.choice(shared) + fresh(r.randrange(40))
        out.append((i, " ".join(w)))
    hot = " ".join(shared[3])
    out += [(100 + i, f"{hot} {i}") for i in range(80)]
    out += [(200 + i, " ".join(shared[4])) for i in range(30)]
    loop = fresh(20)
    out += [(300, " ".join(loop * 5)), (301, "same " * 80), (302, None), (303, ""), (304, " \t\n"), (305, " ".join(fresh(35))), (306, " ".join(fresh(5))), (307, " ".join(fresh(5)))]
    same = " ".join(fresh(50))
    out += [(310, same), (310, same), (None, same), (311, "É é " + " ".join(shared[2]) + "\x0b\x0cz"), (312, " ".join(fresh(30_000) + shared[1]))]
    short = " ".join(fresh(10))
    return [(d, t, "en", "s", 1) for d, t in [*out, (313, short), (314, short)]]


@pytest.mark.parametrize("parts", [1, 5])
def test_against_brute_force(spark, rows, parts, monkeypatch):
    df = spark.createDataFrame(rows, DOCS).selectExpr("*", "1 AS t1", "2 AS at", "'k' AS n_words").repartition(parts)
    got = sorted((tuple(r) for r in s.remove_repeats(df).collect()), key=str)
    assert got == brute(rows)


def test_empty(spark):
    assert s.remove_repeats(spark.createDataFrame([], DOCS)).count() == 0


def test_copies_are_looked_at_once_a_task(spark):
    """A third of the rows are copies of one long text: each of its places leaves a task once, however many slices it reads."""
    from pyspark.sql import functions as F

    long = " ".join(f"w{i}" for i in range(40_000))
    rows = [(i, long if i % 3 == 0 else f"other {i} " * 40) for i in range(90)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2).select(F.xxhash64("text").alias("t1"), F.xxhash64(F.lit(1), "text").alias("t2"), "text")
    got = s.anchors(df).groupBy("t1", "pos", F.spark_partition_id().alias("p")).count()
    assert got.agg(F.max("count")).first()[0] == 1 and got.groupBy("t1", "pos").count().agg(F.max("count")).first()[0] <= 2
    out = {r["doc_id"]: r["n_removed"] for r in s.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out == {i: n for i, t in rows for n in [len(t.split())]}
