import itertools
import zlib

import numpy as np
import pytest

from plumbline.llm import langid

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = {"en": "the and of with water house river stone light", "de": "der und das mit wasser haus fluss stein licht", "xx": "zak ozk ikz uzk kzo kzi azk zzk zko"}


def made(n=240):
    r = np.random.default_rng(0)
    out = []
    for i in range(n):
        lang = list(WORDS)[i % 3]
        out.append((i, " ".join(r.choice(WORDS[lang].split(), 40)), lang, "s", 1))
    return out


def test_marginals_against_all_labellings():
    r = np.random.default_rng(1)
    lengths, k = np.array([3, 0, 1, 4]), 3
    scores, start, trans = r.normal(size=(8, k)), r.normal(size=k), r.normal(size=(k, k))
    gamma, log_z, moves = langid.marginals(scores, lengths, start, trans, moves=True)
    at, total, want_moves = 0, 0.0, np.zeros((k, k))
    for n in lengths:
        p, z, m = np.zeros((n, k)), 0.0, np.zeros((k, k))
        for path in itertools.product(range(k), repeat=int(n)):
            if n:
                w = np.exp(start[path[0]] + sum(scores[at + i, y] for i, y in enumerate(path)) + sum(trans[a, b] for a, b in zip(path, path[1:])))
                z += w
                p[np.arange(n), path] += w
                for a, b in zip(path, path[1:]):
                    m[a, b] += w
        if n:
            assert np.allclose(gamma[at : at + n], p / z)
            total += np.log(z)
            want_moves += m / z
        at += n
    assert np.isclose(total, log_z) and np.allclose(moves, want_moves)


@pytest.mark.parametrize("n", [1, 63, 64, 65, 700])
def test_runs_do_not_show(n):
    r = np.random.default_rng(n)
    scores, start, trans = r.normal(size=(n, 2)) * 3, r.normal(size=2), r.normal(size=(2, 2))
    alpha = [np.exp(start + scores[0])]
    for t in range(1, n):
        a = alpha[-1] @ np.exp(trans) * np.exp(scores[t])
        alpha.append(a / a.sum())
    beta = [np.ones(2)]
    for t in range(n - 1, 0, -1):
        b = np.exp(trans) @ (np.exp(scores[t]) * beta[-1])
        beta.append(b / b.sum())
    want = np.array(alpha) * np.array(beta[::-1])
    got = langid.marginals(scores, np.array([n]), start, trans)[0]
    assert np.allclose(got, want / want.sum(axis=1, keepdims=True))


def test_features_are_those_of_the_word():
    words = [langid.cleaned(w) for w in ("Haus,", "", "12", "a", "é")]
    assert words == [b"haus", b"", b"", b"a", "é".encode()]
    parts = langid.features(words)
    assert [n.tolist() for _, n in parts] == [[1, 0, 0, 1, 1], [5, 0, 0, 2, 3], [4, 0, 0, 1, 2], [3, 0, 0, 0, 1]]
    alone = langid.features([b"haus"])
    assert all((a[: n[0]] == b).all() for (a, n), (b, _) in zip(parts, alone))


def test_code_switched_text_is_labelled_by_runs():
    model = langid.train([t for _, t, *_ in made()], [x for _, _, x, *_ in made()])
    text = " ".join(["der und das mit wasser"] * 12 + ["the river and the stone"] * 4)
    langs, scores, runs = model.label([text, None, "", "123 ...", "the"])
    assert langs == ["de", "und", "und", "und", "en"] and 0.6 < scores[0] < 0.9 and scores[1:4] == [0, 0, 0]
    assert [x[2] for x in runs[0]] == ["de", "en"] and abs(runs[0][0][1] - 60) <= 1


def test_long_texts_by_blocks(monkeypatch):
    model = langid.train([t for _, t, *_ in made()], [x for _, _, x, *_ in made()])
    text = " ".join((["der und das mit wasser 12"] * 30 + ["the river and\n the stone"] * 21) * 8)
    want = model.judged([text, "der und", "x" * 3000])
    monkeypatch.setattr(langid, "BLOCK", 700)
    monkeypatch.setattr(langid, "WORD_BLOCK", 100)
    assert [w for ws in langid.blocks_of(text) for w in ws] == text.split() and all(len(ws) % langid.RUN == 0 for ws in list(langid.blocks_of(text))[:-1])
    got = langid.Model(model.labels, model.weights[:, :-1], model.rows, model.start, model.trans).judged([text, "der und", "x" * 3000])
    assert got[0] == want[0] and np.allclose(got[1], want[1]) and got[2] == want[2] and np.allclose(got[3], want[3])


def test_sample_is_bounded(spark, monkeypatch):
    rows = [(7, f"der und das {i % 3}", "de", "s", 1) for i in range(3000)] + [(8, "the and " * 50_000, "en", "s", 1)] + made(60)
    seen = []
    monkeypatch.setattr(langid, "train", lambda texts, langs: seen.append((texts, langs)))
    langid.fit(spark.createDataFrame(rows, DOCS), per_language=5, rows=12, chars=1200)
    ((texts, langs),) = seen
    assert len(texts) == 12 and sorted(set(langs)) == ["de", "en", "xx"] and max(map(len, texts)) <= 100
    langid.fit(spark.createDataFrame([(i, "a b", f"l{i}", "s", 1) for i in range(90)], DOCS), rows=20)
    assert len(set(seen[1][1])) == sum(not zlib.crc32(str(i).encode()) % 4 == 2 for i in range(90))  # every language is learned


def test_kept_by_evidence(spark):
    rows = made() + [(2000, "水 家 河 " * 20, None, "s", 1), (2001, " ".join(t for _, t, *_ in made(3)), None, "s", 1), (2002, "wasser", None, "s", 1)]
    kept = {r["doc_id"] for r in langid.keep_languages(spark.createDataFrame(rows, DOCS)).collect()}
    assert kept == set(range(240)) | {2001, 2002}


def test_held_out_accuracy(spark):
    rows = made() + [(1000, None, "en", "s", 1), (1001, "123 !", None, None, None), (None, "der und das", "de", "s", 1), (1002, "der und das mit " * 20_000, None, "s", 1), (5, made()[5][1], "xx", "s", 1)]
    df = spark.createDataFrame(rows, DOCS).selectExpr("*", "1 AS score", "2 AS held_out")
    got = langid.op10(df).collect()
    truth = {d: x for d, _, x, *_ in made()}
    assert len(got) == len(rows) and {r["held_out"] for r in got} == {True, False}
    assert all(r["lang_pred"] == truth[r["doc_id"]] for r in got if r["doc_id"] in truth)
    by = {r["doc_id"]: r for r in got}
    assert by[1000]["lang_pred"] == by[1001]["lang_pred"] == "und" and by[None]["lang_pred"] == by[1002]["lang_pred"] == "de"
    clash = spark.createDataFrame(rows, DOCS).selectExpr("*", "1 AS lang_pred", "map('a', 2) AS `lang score`")
    kept = langid.keep_languages(clash)
    assert kept.count() == len(rows) - 2 and kept.schema.simpleString() == clash.schema.simpleString()


def test_labels_of_held_out_rows_do_not_matter(spark):
    rows = made()
    import zlib

    other = [(d, t, "xx" if zlib.crc32(str(d).encode()) % 4 == 2 else x, s, n) for d, t, x, s, n in rows]
    a, b = ([(r["doc_id"], r["lang_pred"], r["score"]) for r in langid.op10(spark.createDataFrame(x, DOCS)).orderBy("doc_id").collect()] for x in (rows, other))
    assert a == b


def test_nothing_to_learn(spark):
    df = spark.createDataFrame([(1, "words", None, "s", 1)], DOCS)
    assert langid.op10(df).first()["lang_pred"] == "und" and langid.op10(df.limit(0)).count() == 0
