import os
import random

import corpus_pipeline
from plumbline.llm import common, overlap
from plumbline.llm.components import connected

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def shingled(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()


def edited(r, words, times):
    out = list(words)
    for _ in range(times):
        out[r.randrange(len(out))] = f"x{r.randrange(10**6)}"
    return out


def planted():
    """Texts with copies at many similarities, a line that many share, and a large group of copies of each other."""
    r, out = random.Random(4), []
    line = [f"licence{i}" for i in range(12)]
    for _ in range(60):
        base = [f"w{r.randrange(3000)}" for _ in range(r.randrange(1, 150))]
        out += [base, *(edited(r, base, r.randrange(1, 6)) for _ in range(r.randrange(3)))]
    out += [line + [f"w{r.randrange(3000)}" for _ in range(r.randrange(6))] for _ in range(60)]
    base = [f"v{r.randrange(3000)}" for _ in range(90)]
    out += [edited(r, base, r.randrange(3)) for _ in range(70)]
    texts = [" ".join(x) for x in out] + [None, "", "  ", " ".join(out[0]).upper()]
    r.shuffle(texts)
    return list(enumerate(texts))


def brute(rows):
    sets, up = {d: shingled(t or "") for d, t in rows}, {d: d for d, _ in rows}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 9 * len(sets[a] & sets[b]) >= 4 * (len(sets[a]) + len(sets[b])):  # c / (n - c) >= 0.8
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return {d: root(d) for d in sets}


def test_groups_against_brute_force(spark):
    rows = planted()
    want = brute(rows)
    links = overlap.similar_texts(spark.createDataFrame(rows, "doc_id long, text string"))
    got = {r["node"]: r["root"] for r in connected(links).collect()}
    assert {d: got.get(d, d) for d in want} == want and len(set(want.values())) < len(want) - 90


def test_common_shingles_and_order_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(overlap, "COMMON", 1)
    monkeypatch.setattr(overlap, "FEW", 3)
    test_groups_against_brute_force(spark)


def test_stage_removes_near_copies(spark):
    r = random.Random(9)
    base = [f"w{r.randrange(3000)}" for _ in range(120)]
    near, far = list(base), list(base)
    near[60] = "other"
    near[90] = "word"
    for i in range(0, 120, 6):
        far[i] = "far"
    rows = [(1, " ".join(base), "en", "s", 1), (2, " ".join(near), "en", "s", 1), (3, " ".join(far), "en", "s", 1), (None, " ".join(base), "en", "s", 1)]
    docs = spark.createDataFrame(rows, DOCS)
    stage = dict(corpus_pipeline.STAGES)["SimHash near-dedup"]
    kept = stage(spark, docs, "")
    assert sorted(x["doc_id"] for x in kept.collect()) == [1, 3] and kept.columns == docs.columns


def test_empty(spark):
    assert overlap.similar_texts(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_small_blocks_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(overlap, "BLOCK", 4)
    monkeypatch.setattr(overlap, "FEW", 3)
    monkeypatch.setattr(overlap, "ROWS_AT_ONCE", 64)
    test_groups_against_brute_force(spark)


def test_a_pair_comes_once(monkeypatch):
    """Two sets that share all of their prefixes, and one that shares all but the first two, whatever piece a shingle is in."""
    import numpy as np
    import pyarrow as pa

    monkeypatch.setattr(overlap, "ROWS_AT_ONCE", 4)
    heads = {1: (0, 1), 2: (0, 1), 3: (1, 2)}
    rows = [(s, k, 100, s - (k == 3), *heads[k]) for s in range(20) for k in heads if k < 3 or s]
    batch = pa.RecordBatch.from_arrays([pa.array(np.array(x)) for x in zip(*rows)], ["s", "key", "n", "pos", "p0", "p1"])
    got = pa.Table.from_batches(overlap._meetings(0.8)(iter([batch])))
    pairs = [(a, b) for a, b in zip(got["a"].to_pylist(), got["b"].to_pylist()) if a is not None]
    assert sorted(pairs) == [(1, 2), (1, 3), (2, 3)]


def test_a_shingle_that_very_many_sets_share(spark):
    """50,000 sets of different components meet by one shingle: only the planted pairs leave the tasks, and cells stay small."""
    import time

    from pyspark.sql import functions as F

    bits = [F.xxhash64(F.when(F.col("id") < 20, F.floor(F.col("id") / 2)).otherwise(F.col("id")), F.lit(i)).alias(c) for i, c in enumerate(overlap.BITMAP)]
    own = spark.range(50_000).select(F.col("id").alias("key"), *bits)
    rows = spark.range(50_000).select(F.lit(7).cast("long").alias("s"), F.col("id").alias("key"), (F.lit(200) + F.col("id") % 2).cast("long").alias("n"), F.lit(0).cast("long").alias("pos"), F.col("id").alias("comp"))
    at = time.time()
    got = sorted(map(tuple, overlap.meeting_pairs(rows, own, 0.8).collect()))
    assert got == [(2 * i, 2 * i + 1) for i in range(10)] and time.time() - at < 150


def test_odd_rows(spark):
    r = random.Random(2)
    base = [f"w{r.randrange(3000)}" for _ in range(100)]
    long = [f"l{r.randrange(10**6)}" for _ in range(60_000)]
    near, other = list(base), [*long[:30_000], "x", *long[30_000:]]
    near[50] = "y"
    rows = [(1, " ".join(base), 1, 1), (1, " ".join(near), 1, 1), (2, " ".join(near), 1, 1), (2, " ".join(near), 1, 1), (3, " ".join(long), 1, 1), (4, " ".join(other), 1, 1), (None, " ".join(long), 1, 1), (5, "one two", 1, 1), (6, "ONE  two", 1, 1)]
    links = overlap.similar_texts(spark.createDataFrame(rows, "doc_id long, text string, key long, n long"))
    assert {(x["node"], x["root"]) for x in connected(links).collect()} == {(1, 1), (2, 1), (3, 3), (4, 3), (5, 5), (6, 5)}


def test_rounds_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(overlap, "ROUND_ROWS", 100)
    monkeypatch.setattr(overlap, "FEW", 3)
    test_groups_against_brute_force(spark)


def shuffle_files(spark):
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    return {f for f in (str(x) for x in disk.getAllFiles().mkString("\n").split("\n")) if "/shuffle_" in f and f.endswith(".data")}


def test_disk_is_given_back(spark):
    """The tables that links are made of are gone once these are there, and so are the shuffles behind a table."""
    docs, mark = spark.createDataFrame(planted(), "doc_id long, text string"), common.held()
    links = overlap.similar_texts(docs)
    assert common.held() == mark + 1 and links.count() > 90
    before, was = shuffle_files(spark), spark.conf.get(common.SHUFFLES_GO, None)
    table = common.written(docs.repartition("doc_id").groupBy("text").count(), "counts")
    assert shuffle_files(spark) <= before and spark.conf.get(common.SHUFFLES_GO, None) == was
    assert table.count() > 90


def test_texts_are_not_shuffled_for_few_ids(spark, monkeypatch):
    """Whatever Spark would broadcast by itself; very many ids are joined as Spark plans it, with the same result."""
    docs = spark.createDataFrame([(d, t, "en", "s", 1) for d, t in planted()], DOCS)
    stage, kept, plans = dict(corpus_pipeline.STAGES)["SimHash near-dedup"], [], []
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for sent in (common.SENT, 0):
            monkeypatch.setattr(common, "SENT", sent)
            got = stage(spark, docs, "")
            plans.append(got._jdf.queryExecution().executedPlan().toString())
            kept.append(sorted(x["doc_id"] for x in got.collect()))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" not in plans[0] and "SortMergeJoin" in plans[1]
    assert kept[0] == kept[1] and len(kept[0]) < len(planted()) - 90


def test_cells_are_dealt_out_in_rounds(spark, monkeypatch):
    """A group of many blocks: a row stands in MOST cells of its class at most, a round deals LEAST rows or so, no pair is lost."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(overlap, "BLOCK", 10)
    monkeypatch.setattr(overlap, "MOST", 5)
    monkeypatch.setattr(overlap, "LEAST", 2_000)
    monkeypatch.setattr(overlap, "CELLS", 1)
    bits = [F.xxhash64(F.when(F.col("id") < 20, F.floor(F.col("id") / 2)).otherwise(F.col("id")), F.lit(i)).alias(c) for i, c in enumerate(overlap.BITMAP)]
    own = spark.range(1_000).select(F.col("id").alias("key"), *bits)
    rows = spark.range(1_000).select(F.lit(7).cast("long").alias("s"), F.col("id").alias("key"), F.lit(200).cast("long").alias("n"), F.lit(0).cast("long").alias("pos"), F.col("id").alias("comp"))
    made, write = {}, common.written
    monkeypatch.setattr(overlap, "written", lambda df, name: made.setdefault(name, []).append(df) or write(df, name))
    got = sorted(map(tuple, overlap.meeting_pairs(rows, own, 0.8).collect()))
    assert got == [(2 * i, 2 * i + 1) for i in range(10)]
    assert len(made["overlap-compared"]) == 3 and write(made["overlap-met"][0], "met").first()["same"] == 5


def test_pairs_are_checked_in_turns(spark, monkeypatch):
    for name, value in {"LED": 10**6, "LED_LEAST": 60, "WHOLE": 10**6, "WHOLE_LEAST": 60}.items():
        monkeypatch.setattr(overlap, name, value)
    names, write = [], common.written
    monkeypatch.setattr(overlap, "written", lambda df, name: names.append(name) or write(df, name))
    test_groups_against_brute_force(spark)
    assert names.count("overlap-pairs") > 2 and names.count("overlap-links") > 2
