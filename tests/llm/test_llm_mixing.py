import hashlib
import math

import pytest

from plumbline.llm import mixing

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def water(sizes, weights=(1, 2, 3)):
    """Targets by definition: what stops at three times its size, and the rest shared again."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    fixed, total = {}, sum(sizes.values())
    while True:
        free = [s for s in names if s not in fixed]
        level = (total - sum(fixed.values())) / sum(w[s] for s in free) if free else 0
        above = [s for s in free if w[s] * level > 3 * sizes[s]]
        if not above:
            return fixed | {s: w[s] * level for s in free}
        fixed |= {s: 3 * sizes[s] for s in above}


@pytest.fixture(scope="module")
def rows():
    out = [(i, "w " * (i % 50 + 1), "en", "big", 1) for i in range(900)]
    out += [(1000 + i, "x y z", "en", f"s{i % 5}", 1) for i in range(60)]
    out += [(2000, None, None, None, None), (2001, "in no source", "en", None, 1), (None, "no id", "en", "s1", 1), (2002, " \t", "en", "blank", 1), (2003, "é", "en", "É", 1), (1001, "x y z", "en", "s1", 1)]
    return out


def test_against_the_definition(spark, rows):
    df = spark.createDataFrame(rows, DOCS).selectExpr("*", "7 AS size", "8 AS target", "9 AS taken")
    got = mixing.op6(df).collect()
    sizes = {}
    for _, t, _, s, _ in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    want = water(sizes)
    source = {(d, len((t or "").split())): s for d, t, _, s, _ in rows}
    taken = dict.fromkeys(sizes, 0)
    for r in got:
        s = source[r["doc_id"], r["size"]]
        assert r["source_size"] == sizes[s] and r["target"] == pytest.approx(want[s])
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[s] += r["taken"]
    assert len(got) == len(rows)
    for s, t in taken.items():
        assert abs(t - want[s]) <= max(50, 0.02 * want[s])
    assert sorted(map(str, got)) == sorted(map(str, mixing.op6(df.repartition(7)).collect()))


def test_against_sql(spark, rows):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR, n_chars BIGINT)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?, ?, ?)", rows)
    got = [tuple(r) for r in mixing.op6(spark.createDataFrame(rows, DOCS)).collect()]
    assert sorted(got, key=str) == sorted(con.execute(mixing.OP6_SQL).fetchall(), key=str)


def test_the_mix_holds_each_row_as_often_as_it_is_taken(spark, rows):
    df = spark.createDataFrame(rows, DOCS)
    copies = {}
    for r in mixing.op6(df).where("size > 0").collect():
        copies[r["doc_id"]] = copies.get(r["doc_id"], 0) + r["taken"] // r["size"]
    mixed = mixing.mix(df)
    got = {}
    for r in mixed.where("text IS NOT NULL AND trim(text) <> '' AND text <> ' \t'").collect():
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + 1
    assert got == {d: n for d, n in copies.items() if n} and mixed.columns == df.columns


def test_a_doc_id_of_a_third_of_the_rows_is_cut_into_runs(spark):
    rows = [(7 if i % 3 == 0 else i, " ".join(f"w{i}x{k}" for k in range(40 + i % 3)), "en", "s", 1) for i in range(3000)]
    rows += [(9000 + i, f"only {i} here", "en", "t", 1) for i in range(3000)]
    df = spark.createDataFrame(rows, DOCS)
    sizes = mixing._sizes(df)
    hot = mixing.repeated(sizes)
    assert hashlib.md5(b"7").hexdigest() in hot and hashlib.md5(b"").hexdigest() in hot and hot == sorted(hot) and len(hot) <= mixing.MOST + 1
    # the order is that of hash, doc_id, size and mark, whatever is cut out of it
    key = lambda r: (len(f"{r[1]:b}"), f"{r[1]:b}"[:5], hashlib.md5(str(r[0]).encode()).hexdigest(), r[0], r[1], r[2])
    ranked = sorted(((d, len(t.split()), hashlib.md5(t.encode()).hexdigest()) for d, t, _, s, _ in rows if s == "s"), key=key)
    offset = int(hashlib.md5(b"0:s").hexdigest()[:4], 16) / 65536
    found = mixing.with_copies(sizes, sizes).where("source = 's'").collect()
    rate = found[0]["target"] / found[0]["source_size"]
    got = {r["mark"]: r["copies"] for r in found}
    assert 0.1 < rate < 0.9 and set(got.values()) == {0, 1}
    assert got == {m: math.floor(offset + k * rate) - math.floor(offset + (k - 1) * rate) for k, (_, _, m) in enumerate(ranked, 1)}


def test_empty(spark):
    assert mixing.op6(spark.createDataFrame([], DOCS)).count() == 0
    assert mixing.op6(spark.createDataFrame([(1, None, "en", "s", 0)], DOCS)).first()["taken"] == 0
