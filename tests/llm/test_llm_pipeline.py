import public_tokenizers
import pytest
from tokenizers import Tokenizer

import __spark_entry__ as driver
import corpus_pipeline
from plumbline.llm import decontaminate, langid, mixing, queries, simhash

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
VOICES = {"en": "the and of with water house river stone light over under", "de": "der und das mit wasser haus fluss stein licht über unter"}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    import random

    r = random.Random(0)
    at = tmp_path_factory.mktemp("sf")
    bench = [(i, " ".join(f"q{i}w{k}" for k in range(20))) for i in range(3)]
    rows = []
    for i in range(200):
        lang = "en" if i % 2 else "de"
        rows.append((i, " ".join(r.choice(VOICES[lang].split()) for _ in range(r.randrange(30, 200))), lang, f"s{i % 4}"))
    rows += [(300, rows[3][1], "en", "s0"), (301, None, "en", "s0"), (302, "12 34", "en", "s1"), (303, " ".join(r.choice(VOICES["en"].split()) for _ in range(60)) + " " + bench[1][1], "en", "s2"), (304, rows[9][1] + " water", "en", "s1"), (None, rows[7][1], None, None)]
    spark.createDataFrame([(*x, len(x[1] or "")) for x in rows], DOCS).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return str(at)


def test_stages_against_brute_force(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, took = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, folder).collect(), docs.schema)
        assert docs.columns == columns
        took[name] = [r["doc_id"] for r in docs.collect()]
    kept = list(took.values())
    assert sorted(set(range(200)) | {300, 303, 304} | {None}, key=str) == sorted(set(kept[0]), key=str)
    assert sorted(kept[1]) == [*range(200), 303] and sorted(kept[2]) == list(range(200))
    source = {i: i % 4 for i in range(200)}
    assert set(kept[3]) <= set(source) and max(map(kept[3].count, kept[3])) <= 3
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    got = corpus_pipeline.run(spark, folder).orderBy("start").collect()
    assert [r["doc_id"] for r in got] == sorted(kept[3])
    assert [r["n_tokens"] for r in got] == [len(t.encode(texts[d], add_special_tokens=False).ids) + 1 for d in sorted(kept[3])]


def test_registered():
    names = driver.queries()
    assert {f"op{n}" for n in range(1, 14)} == {x.split("_")[0] for x in queries.QUERIES} and "pipeline" in names
    assert set(queries.ORACLE_SQL) <= set(queries.QUERIES)
    assert 4 <= len(corpus_pipeline.STAGES) <= 5 and all(hasattr(m, "__doc__") for m in (decontaminate, langid, mixing, simhash))
