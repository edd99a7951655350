import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from plumbline.llm import chat, media, sharding

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


# --- audio ---


def test_wav_round_trip():
    for samples in (b"", b"a", b"abc" * 1000):
        assert media.samples_of(media.wav(samples)) == (media.RATE, samples)
    for bad in (b"", b"RIFF", media.wav(b"abcd")[:-2], b"JUNK" + media.wav(b"ab")[4:]):
        with pytest.raises(ValueError):
            media.samples_of(bad)


@pytest.mark.parametrize("up, down", [(1, 2), (2, 3), (3, 1), (1, 1)])
def test_polyphase_equals_filtering_at_the_common_rate(up, down):
    x = np.random.default_rng(1).normal(size=101).astype(np.float32)
    h = media._filter(up, down).T.reshape(-1)
    wide = np.zeros(len(x) * up)
    wide[::up] = x
    full = np.convolve(wide, h)
    n, shift = -(-len(x) * up // down), up * (media.TAPS - 1 - media.TAPS // 2)
    want = np.array([full[shift + k * down] if 0 <= shift + k * down < len(full) else 0 for k in range(n)])
    assert np.allclose(media.resample(x, up, down), want, atol=1e-5)


def test_resampling_keeps_a_low_tone():
    t = np.arange(16_000) / 16_000
    y = media.resample(np.sin(2 * np.pi * 440 * t), 1, 2)
    assert len(y) == 8000 and abs(np.abs(np.fft.rfft(y)).argmax() - 440) <= 1 and 0.95 < np.abs(y[100:-100]).max() < 1.05


def test_a_tone_lights_its_band():
    x = np.sin(2 * np.pi * 1000 * np.arange(8000) / 8000).astype(np.float32)
    mels, energy = media.log_mels(x, 8000)
    peak = media.mel_bank(8000)[int(1000 / 8000 * media.FFT)].argmax()
    assert mels.shape == (len(energy), media.MELS) and (mels[5:-5].argmax(axis=1) == peak).all()


def test_hysteresis():
    e = np.array([0, 0, 9, 5, 5, 9, 5, 0, 5, 5, 0, 9, 0], float)
    mean, spread = e.mean(), e.std()
    on, want = False, []
    for v in e:
        on = True if v > mean + spread / 2 else False if v < mean - spread / 2 else on
        want.append(on)
    got = np.zeros(len(e), bool)
    for a, b in media.active(e):
        got[a:b] = True
    assert got.tolist() == want
    assert media.active(np.zeros(3)) == []


def test_blocks_of_frames_do_not_show(monkeypatch):
    x = np.random.default_rng(2).normal(size=9000).astype(np.float32)
    one = media.log_mels(x, 8000)
    monkeypatch.setattr(media, "FRAMES_AT_ONCE", 7)
    assert all(np.allclose(a, b, atol=1e-5) for a, b in zip(one, media.log_mels(x, 8000)))


def test_stored_documents(spark):
    rows = [(1, "hello", "x", 1), (2, None, "x", 1), (3, "", "x", 1), (4, "é" * 96, "x", 1), (5, "long " * 40_000, "x", 1), (None, "hello", "x", 1), (1, "hello", "x", 1), (6, "x" * 192, "x", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, media string, n_bytes long")
    got = media.op4(df).collect()
    assert len(got) == len(rows)
    texts = {d: t for d, t, *_ in rows if d is not None}
    for r in got:
        raw = (texts[r["doc_id"]] if r["doc_id"] is not None else "hello") or ""
        raw = raw.encode()
        want = raw + b" " * (max(1, -(-len(raw) // 192)) * 192 - len(raw))
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(want), hashlib.sha256(want).hexdigest(), zlib.crc32(want[-16:]))
        assert (r["media_bytes"], r["media_sha256"]) == (len(media.wav(want)), hashlib.sha256(media.wav(want)).hexdigest())
    same = [tuple(r)[1:] for r in got if r["n_bytes"] == 5]
    assert len(same) == 3 and len(set(same)) == 1 and len({tuple(r)[1:] for r in got if r["n_bytes"] == 0}) == 1
    assert media.op4(df.limit(0)).count() == 0


def direct_features(raw):
    """Frames, spans and log-mels of 8-bit samples at 16 kHz: a plain convolution, a DFT written out, and a loop."""
    x = (np.frombuffer(raw, np.uint8).astype(float) - 128) / 128
    t = np.arange(24) - 11.5
    h = np.sinc(t / 2) * np.hamming(24)
    y = np.convolve(x, h / h.sum())[11::2][: -(-len(x) // 2)]  # half the rate
    n = 1 + max(0, -(-(len(y) - 200) // 80))
    y = np.concatenate((y, np.zeros((n - 1) * 80 + 200 - len(y))))
    frames = np.array([y[80 * i : 80 * i + 200] * np.hanning(200) for i in range(n)])
    dft = np.exp(-2j * np.pi * np.outer(np.arange(200), np.arange(129)) / 256)
    power = np.abs(frames @ dft) ** 2
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = [700 * (10 ** (m / 2595) - 1) for m in np.linspace(mel(60), mel(4000), 26)]
    bank = np.zeros((129, 24))
    for b in range(24):
        for k in range(129):
            f = k * 8000 / 256
            bank[k, b] = max(0, min((f - edges[b]) / (edges[b + 1] - edges[b]), (edges[b + 2] - f) / (edges[b + 2] - edges[b + 1])))
    energy = np.log((frames**2).mean(1) + 1e-9)
    up, down, on, spans = energy.mean() + energy.std() / 2, energy.mean() - energy.std() / 2, None, []
    for i, e in enumerate([*energy, -np.inf]):
        if on is None and e > up and i < n:
            on = i
        elif on is not None and (e < down or i == n):
            spans.append((on, i))
            on = None
    return n, spans, np.log(power @ bank + 1e-6)


def test_features_against_direct_computation(spark):
    texts = ["hello world " * 300, "a" * 500 + "zq~" * 900 + " " * 700 + "The quick brown fox. " * 90, "é" * 96, None, "long text with words " * 20_000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    made = {r["doc_id"]: r for r in media.features(media.stored(df)).collect()}
    told = {r["doc_id"]: r["feature"] for r in media.op4(df).collect()}
    for d, text in enumerate(texts):
        raw = (text or "").encode()
        n, spans, mels = direct_features(raw + b" " * (max(1, -(-len(raw) // 192)) * 192 - len(raw)))
        r = made[d]
        assert r["frames"] == n and [(round(s["start_ms"]), round(s["end_ms"])) for s in r["spans"]] == [(10 * a, 10 * (b - 1) + 25) for a, b in spans]
        got = pa.ipc.open_stream(r["tensors"]).read_all()
        want = [mels[p : min(p + 64, b)] for a, b in spans for p in range(a, b, 64)]
        tensors = got.column("log_mel").combine_chunks().to_numpy_ndarray() if len(got) else np.zeros((0, 64, 24))
        assert len(tensors) == len(want)
        for t, w in zip(tensors, want):
            assert np.allclose(t[: len(w)], w, atol=2e-2) and not t[len(w) :].any()
        assert told[d] == f"{n}:{len(spans)}:{hashlib.sha256(r['tensors']).hexdigest()}"
    assert any(":0:" not in f for f in told.values())


def test_tensors_have_their_shape_and_times():
    x = np.concatenate([np.zeros(8000), np.sin(np.arange(24_000)) * 120, np.zeros(8000)]) + 128
    stream, frames, spans = media.tensor_stream(media.wav(x.astype(np.uint8).tobytes()))
    table = pa.ipc.open_stream(stream).read_all()
    assert table.schema.field("log_mel").type == pa.fixed_shape_tensor(pa.float32(), (media.PATCH, media.MELS))
    assert len(spans) == 1 and abs(spans[0][0] - 500) < 40 and abs(spans[0][1] - 2000) < 40
    assert table.column("start_ms")[0].as_py() == spans[0][0] and table.column("end_ms")[-1].as_py() == spans[0][1]
    assert len(table) == -(-round((spans[0][1] - 25 - spans[0][0]) / 10 + 1) // media.PATCH) and frames == 249


# --- chat ---

TALK = "conv_id long, turn long, role string, text string, example string"


def brute_chat(rows):
    talks = {}
    for c, t, r, x, *_ in rows:
        talks.setdefault(c, []).append((t is not None, t or 0, r or "", x or ""))
    out = {}
    esc = lambda s: s.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")
    for c, turns in talks.items():
        turns.sort()
        pieces = [f"<turn {esc(r)}>\n{esc(x)}</turn>\n" for *_, r, x in turns]
        said = "".join(x for *_, r, x in turns if r == "assistant")
        chars = sum(sum(map(len, pieces[: k + 1])) for k, t in enumerate(turns) if t[2] == "assistant" or k == len(turns) - 1)
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        out[c] = (len(turns), sha("".join(f"{r}\n{x}\n" for *_, r, x in turns)), len(said), sha(said), chars)
    return out


def talk_rows():
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "</turn>\n<turn user>\n &lt; & \\"), (1, 2, "user", "more"), (1, 3, "assistant", ""), (1, 4, "user", "tail é😀")]
    rows += [(2, 0, "system", "only"), (3, 0, "assistant", "first"), (3, None, None, None), (3, 1, "assistant", "second"), (None, 0, "user", "lost"), (None, 1, "assistant", "id")]
    rows += [(4, 0, "a>\nb", "x"), (4, 0, "a>\nb", "x"), (5, 0, "assistant", "z" * 100_000), (6, 0, "assistant ", "not quite")]
    rows += [(7, k, "assistant" if k % 2 else "user", f"turn {k}") for k in range(120)]
    return rows


def test_chat(spark):
    rows = talk_rows()
    df = spark.createDataFrame([(*r, "clash") for r in rows], TALK)
    want = brute_chat([*rows, (-7, 0, "user", chat.PROBE), (-7, 1, "assistant", chat.PROBE)])
    assert {r[0]: tuple(r)[1:] for r in chat.op8(df).collect()} == want
    assert chat.op8(df.limit(0)).count() == 1


def test_chat_against_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    rows = [r for r in talk_rows() if r[0] is not None]
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    got = [tuple(r) for r in chat.op8(spark.createDataFrame([(*r, "") for r in rows], TALK)).collect()]
    assert sorted(got) == sorted(con.execute(chat.OP8_SQL).fetchall())


def test_each_example_trains_one_reply(spark):
    df = spark.createDataFrame([(*r, "") for r in talk_rows()], TALK)
    got = chat.examples(df).where("conv_id = 1").orderBy("example").collect()
    assert [(r["example"], r["loss_start"] is not None) for r in got] == [(2, True), (4, True), (5, False)]
    assert got[1]["text"].startswith(got[0]["text"]) and got[0]["text"][got[0]["loss_start"] : got[0]["loss_end"]].startswith("&lt;/turn&gt;")


# --- shards ---


def brute_capacity(sizes, shards):
    """The least possible largest shard of contiguous runs, by dynamic programming."""
    prefix = np.concatenate(([0], np.cumsum(sizes)))
    best = prefix.astype(float)
    for _ in range(shards - 1):
        best = np.array([0.0, *(min(max(best[j], prefix[i] - prefix[j]) for j in range(i + 1)) for i in range(1, len(prefix)))])
    return int(best[-1])


@pytest.mark.parametrize("seed, coarse", [(0, 12), (1, 1), (2, 2), (3, 1)])
def test_capacity_is_the_smallest(spark, monkeypatch, seed, coarse):
    monkeypatch.setattr(sharding, "COARSE", coarse)
    monkeypatch.setattr(sharding, "FINER", 2)
    r = random.Random(seed)
    groups = {r.getrandbits(64) - (1 << 63): r.randrange(1, 300) for _ in range(90)}
    cuts = sharding.plan(spark.createDataFrame(list(groups.items()), "h long, bytes long"), 5)
    order = [groups[h] for h in sorted(groups) if h not in cuts.alone]
    assert cuts.capacity == brute_capacity(order, 5 - len(cuts.alone)) and len(cuts.upper) <= 4 - len(cuts.alone)


def test_shards(spark):
    rows = [(i, f"text {i} " * (i % 9 + 1), "en", "s", 1) for i in range(600)] + [(1000 + i, "a copy " * 30, "en", "s", 1) for i in range(200)]
    rows += [(2000, None, None, None, None), (2001, None, "en", "s", 1), (2002, "", "en", "s", 1), (None, "no id é", "en", "s", 1), (5, "text 5 " * 6, "en", "s", 1), (2003, "x" * 9000, "en", "s", 1)]
    df = spark.createDataFrame(rows, DOCS).selectExpr("*", "1 AS size", "2 AS shard", "3 AS slot", "4 AS h")
    got = sharding.op9(df).collect()
    texts = {d: t for d, t, *_ in rows}
    size, slots, home = [0] * 16, {}, {}
    for r in got:
        raw = (texts[r["doc_id"]] or "").encode()
        assert r["size"] == len(raw) + 1 and r["text_crc32"] == zlib.crc32(raw) and r["law"] == "bytes" and r["grown_shard"] is None and 0 <= r["shard"] < 16
        size[r["shard"]] += r["size"]
        slots.setdefault(r["shard"], []).append(r["slot"])
        assert home.setdefault(texts[r["doc_id"]], r["shard"]) == r["shard"]
    assert len(got) == len(rows) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    group = 200 * (len("a copy " * 30) + 1)
    rest = sorted(size)[:-1]
    assert max(size) == group and max(rest) <= 1.35 * (sum(size) - group) / 15 + 9001
    again = sharding.op9(df.repartition(5)).collect()
    assert sorted((str(r["doc_id"]), r["shard"]) for r in again) == sorted((str(r["doc_id"]), r["shard"]) for r in got)


def test_few_and_no_rows(spark):
    df = spark.createDataFrame([(1, "a", "en", "s", 1)], DOCS)
    assert [tuple(r)[4:6] for r in sharding.op9(df).collect()] == [(0, 0)]
    assert sharding.op9(df.limit(0)).count() == 0


def test_equal_rows_are_numbered_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(sharding, "TOGETHER", 7)
    rows = [(5, "again and again", None, None, 1)] * 40 + [(None, None, None, None, None)] * 15 + [(100 + i, f"text {i} " * (i % 9 + 1), None, None, 1) for i in range(60)]
    got = sharding.op9(spark.createDataFrame(rows, DOCS)).collect()
    slots, homes = {}, {}
    for r in got:
        slots.setdefault(r["shard"], []).append(r["slot"])
        homes.setdefault(r["doc_id"], []).append(r["shard"])
    assert len(got) == len(rows) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert len(homes[5]) == 40 and len(set(homes[5])) == 1 and len(homes[None]) == 15 and len(set(homes[None])) == 1
