import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from plumbline.llm import ans, tokenfile, tokens

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = ["", None, " ", "  a  b ", "a  b", "a 　b c", "x\n y z\n", "é è ê", " lead and trail ", "a<|endoftext|> b <|endoftext|> c", "tab\t here  x", "emoji 😀 x 😀y z", "a  b", "\x1c a b\x1c c", "don't we'll 's", "12 34 5a", "y" * 70_000, "w " * 9000]


@pytest.fixture(scope="module")
def plain():
    return Tokenizer.from_file(PATH)


def whole(plain, text):
    return plain.encode(text or "", add_special_tokens=False).ids


def split(encoder, texts):
    ids, n = encoder.encode(texts)
    return [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])]


def test_pieces_give_the_ids_of_whole_texts(plain):
    assert split(tokens.Encoder.at_path(PATH), ODD) == [whole(plain, t) for t in ODD]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list("ab'1. \n\t  é日😀<|>"))), max_size=4))
def test_pieces_of_any_text(texts):
    if texts:
        t = Tokenizer.from_file(PATH) if not hasattr(test_pieces_of_any_text, "t") else test_pieces_of_any_text.t
        test_pieces_of_any_text.t = t
        assert split(tokens.Encoder.at_path(PATH), texts) == [whole(t, x) for x in texts]


def test_long_texts_by_parts(plain, monkeypatch):
    monkeypatch.setattr(tokens, "AT_ONCE", 50)
    texts = [*ODD, "y z" * 50_000, "日本" * 60_000]
    assert split(tokens.Encoder.at_path(PATH), texts) == [whole(plain, t) for t in texts]


def test_a_full_table_starts_again(plain, monkeypatch):
    monkeypatch.setattr(tokens, "HELD", 50)
    e = tokens.Encoder(PATH)
    for k in range(0, 400, 20):
        texts = [" ".join(f"word{i}" for i in range(k, k + 20))]
        assert split(e, texts) == [whole(plain, texts[0])]


def test_memory_is_bounded_by_ids(plain):
    e = tokens.Encoder(PATH)
    r = np.random.default_rng(0)
    for k in range(6):  # neither text without spaces nor very many different words stay in a worker
        texts = ["".join(map(chr, r.integers(0x4E00, 0x9000, 60_000))), " ".join(f"{x:x}" for x in r.integers(0, 1 << 60, 70_000))]
        assert split(e, texts) == [whole(plain, t) for t in texts]
        assert len(e.flat) <= tokens.HELD_IDS and len(e.known) <= tokens.HELD and e.ends[-1] == len(e.flat)
    assert max(map(len, e.known.to_pylist())) <= tokens.LONGEST


def test_pieces_are_told_apart_by_their_bytes(plain):
    """Strings that collide under a polynomial hash modulo 2 ** 64 whatever its odd base (Thue-Morse) are no trouble."""
    a, b = "a", "b"
    for _ in range(12):
        a, b = a + b, b + a
    texts = [f"x {a} y", f"x {b} y", f"{b} {a}"]
    e = tokens.Encoder(PATH)
    assert split(e, texts) == [whole(plain, t) for t in texts] and split(e, texts[::-1]) == [whole(plain, t) for t in texts[::-1]]


def test_spans_are_those_of_the_tokenizer(plain, monkeypatch):
    texts = [t or "" for t in ODD] + ["日本 x " * 40, "y" * 900]
    want = [plain.encode(t, add_special_tokens=False).offsets for t in texts]
    for size in (1_000_000, 100):
        monkeypatch.setattr(tokens, "WHOLE", size)
        assert [list(map(tuple, x.tolist())) for x in tokens.Encoder(PATH).spans(texts)] == want


def test_spans_of_all_documents_are_those_of_the_tokenizer(plain):
    texts = [t or "" for t in pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"]).column(0).to_pylist()]
    for text, got in zip(texts, tokens.Encoder(PATH).spans(texts)):
        assert list(map(tuple, got.tolist())) == plain.encode(text, add_special_tokens=False).offsets


def test_bytes_that_do_not_add_up_are_asked_for(plain):
    e = tokens.Encoder(PATH)
    e.lengths = e.lengths + 1
    assert [list(map(tuple, x.tolist())) for x in e.spans(["one two é", ""])] == [plain.encode("one two é", add_special_tokens=False).offsets, []]


def test_spans_of_other_tokenizers():
    path = public_tokenizers.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    assert [list(map(tuple, x.tolist())) for x in tokens.Encoder(path).spans(["Some Words é here"])] == [t.encode("Some Words é here", add_special_tokens=False).offsets]


def test_other_tokenizers_encode_in_one_go():
    path = public_tokenizers.path("word_bpe_49k.json")
    e, t = tokens.Encoder(path), Tokenizer.from_file(path)
    assert split(e, ["Some Words here", ""]) == [t.encode(x, add_special_tokens=False).ids for x in ("Some Words here", "")]


def brute_sections(plain, text):
    text = text or ""
    cuts = [0] + [i + 1 for i, c in enumerate(text[:-1]) if c == "\n"] + [len(text)]
    n = [0] * (len(cuts) - 1)
    for a, b in plain.encode(text, add_special_tokens=False).offsets:
        over = [(min(b, y) - max(a, x), -k) for k, (x, y) in enumerate(zip(cuts, cuts[1:]))]
        n[-max(over)[1]] += 1
    return [(k, cuts[k], cuts[k + 1], n[k], sum(n)) for k in range(len(n))]


def test_sections(spark, plain):
    texts = [*ODD[:-2], "a\n\n\nb", "one\ntwo words\n", "é\n😀\nx", "\n"]
    rows = [(i, t, "x", 1) for i, t in enumerate(texts)] + [(None, "a\nb", "x", 1), (3, texts[3], "x", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, section string, n_tokens int")
    got = sorted(((r["doc_id"], r["section"], r["char_start"], r["char_end"], r["n_tokens"], r["doc_tokens"]) for r in tokens.section_counts(df, PATH).collect()), key=str)
    assert got == sorted(((d, *s) for d, t, *_ in rows for s in brute_sections(plain, t)), key=str)
    assert tokens.section_counts(df.limit(0), PATH).count() == 0


def sections(encoder, texts, cut="\n"):
    return list(zip(*(x.tolist() for x in encoder.sections(pa.array(texts, pa.string()).fill_null(""), cut))))


def test_sections_of_a_slice_are_found_without_spans_of_each_text(plain, monkeypatch):
    texts = ["", *ODD, "a\n\n\nb", "one\ntwo words\n", "é\n😀\nx", "\n", "", " \n \n  \n\tx", None, "日本\n\n\n語 \n"] * 2
    e = tokens.Encoder(PATH)
    monkeypatch.setattr(e, "spans", None)
    want = [(i, *s) for i, t in enumerate(texts) for s in brute_sections(plain, t)]
    assert sections(e, texts) == want
    at = pa.array(["cut off", *texts, "cut off"])[1:-1].fill_null("")
    assert list(zip(*(x.tolist() for x in e.sections(at, "\n")))) == want
    assert sections(e, ["", None]) == [(0, 0, 0, 0, 0, 0), (1, 0, 0, 0, 0, 0)]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list("ab'1 \n\té日😀=-"))), min_size=1, max_size=5), st.sampled_from("\na=é日😀"))
def test_sections_of_a_slice_are_those_of_single_texts(texts, cut):
    e = tokens.Encoder.at_path(PATH)
    got = sections(e, texts, cut)
    with pytest.MonkeyPatch.context() as m:
        m.setattr(e, "tiling", False)  # so the library's offsets are asked for, text by text
        assert got == sections(e, texts, cut)


def test_sections_where_bytes_do_not_add_up_or_a_text_is_long(plain, monkeypatch):
    texts = ["one\ntwo é\n\n", "", "three 日\n" * 30]
    want = [(i, *s) for i, t in enumerate(texts) for s in brute_sections(plain, t)]
    monkeypatch.setattr(tokens, "WHOLE", 100)
    assert sections(tokens.Encoder(PATH), texts) == want
    monkeypatch.undo()
    e = tokens.Encoder(PATH)
    e.lengths = e.lengths + 1
    assert sections(e, texts) == want


def test_boundary_rule():
    cuts = np.array([0, 4, 8])
    assert tokens.attribute(np.array([3, 3, 2]), np.array([5, 6, 6]), cuts).tolist() == [2, 1]  # a tie goes to the earlier one


@pytest.mark.parametrize("sizes", [[1], [31, 32, 33], [8192, 8193, 1], [20_000, 5]])
def test_rans_round_trip(sizes):
    r = np.random.default_rng(sum(sizes))
    blocks = [np.minimum(r.zipf(1.3, n), 50_000).astype(np.uint16) for n in sizes]
    table = ans.Table.of(np.bincount(np.concatenate(blocks)))
    assert int(table.freq.sum()) == 1 << table.bits
    coded = ans.encode(blocks, table)
    assert all((a == b).all() for a, b in zip(ans.decode(coded, table), blocks))
    assert [x.tolist() for x in ans.decode(coded[-1:], table)] == [blocks[-1].tolist()]


def test_rans_comes_near_the_entropy_and_sees_damage():
    r = np.random.default_rng(0)
    x = np.minimum(r.zipf(1.5, 200_000), 5000).astype(np.uint16)
    n = np.bincount(x)
    p = n[n > 0] / len(x)
    (coded,) = ans.encode([x], table := ans.Table.of(n))
    assert len(coded) < 1.05 * len(x) * -(p * np.log2(p)).sum() / 8 + 300 * (len(x) // ans.SEGMENT + 1)
    with pytest.raises(ValueError):
        ans.decode([coded[:-400] + bytes(400)], table)


def test_token_files(spark, plain):
    rows = [(5, "five", "x"), (1, None, "x"), (3, "three é", "x"), (None, "none", "x"), (3, "three é", "x"), (3, "three", "x"), (9, "w " * 70_000, "x"), (10, "", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = sorted(((r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in tokenfile.op5(df, PATH).collect()), key=lambda r: r[1])
    assert [g[0] for g in got] == [None, 1, 3, 3, 3, 5, 9, 10]
    want = {(d, t): np.array([*whole(plain, t), 2], "<u4") for d, t, _ in rows}
    assert sorted((d, n, c) for d, _, n, c in got if d is not None) == sorted((d, len(want[d, t]), zlib.crc32(want[d, t].tobytes())) for d, t, _ in rows if d is not None)
    at = 0
    for _, start, n, _ in got:
        assert start == at
        at += n
    assert tokenfile.op5(df.limit(0), PATH).count() == 0


def test_read_back_ids_over_many_parts(spark, plain, tmp_path, monkeypatch):
    monkeypatch.setattr(tokenfile, "PART", 2000)
    rows = [(i, f"text number {i} " * (i % 7)) for i in range(400)]
    tokenfile.write(spark.createDataFrame(rows, "doc_id long, text string"), f"file://{tmp_path}/f", PATH)
    got = {r["doc_id"]: r["ids"] for r in tokenfile.read(spark, f"file://{tmp_path}/f", with_ids=True).collect()}
    assert got == {i: [*whole(plain, t), 2] for i, t in rows}


def test_a_word_with_and_without_a_stop_is_one_piece():
    encoder = tokens.Encoder(PATH)
    texts = ["one, one. one! one", "a.b c;d 'tis it's, don't.x", "é, ñ. 1,2 a,,b a, b\n.c \t, x", ",", ".a", "", "end."]
    ids, n = encoder.encode(texts)
    library = Tokenizer.from_file(PATH)
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert ids.tolist() == sum(want, []) and n.tolist() == list(map(len, want))
    encoder = tokens.Encoder(PATH)
    encoder.encode([" word, word. word! word"])
    assert sorted(encoder.known.to_pylist()) == [b" word", b"!", b",", b"."]


def test_a_word_is_one_piece_whatever_sign_digit_or_line_end_follows(plain):
    encoder = tokens.Encoder(PATH)
    texts = ["x word### word7 word\tword)", " word\n word é\nword 7word", "<|endoftext|>word<|<|endoftext|>\n\nword\n's 'll9 it's!'s", "мир, мир\nмир × 3×3÷é÷", " b ", "  x", " \n", "\n\nx \n y\n"]
    assert split(encoder, texts) == [whole(plain, t) for t in texts]
    encoder = tokens.Encoder(PATH)
    encoder.encode([" word### word7 word\nword| мир, мир\n"])
    assert sorted(encoder.known.to_pylist()) == sorted([b" word", b"word", b"###", b"7", b"\n", b"|", " мир".encode(), b","])


def test_pieces_met_again_and_again_stay_in_a_full_table(monkeypatch):
    monkeypatch.setattr(tokens, "HELD", 50)
    e, texts = tokens.Encoder(PATH), []
    batch = e._batch
    e._batch = lambda x: texts.extend(x) or batch(x)
    for k in range(0, 400, 20):
        e.encode([" common" + "".join(f" word{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(k, k + 20))])
    assert sum(t.count(" common") for t in texts) == 1


def test_what_a_worker_remembers_stays_small():
    e = tokens.Encoder(PATH)
    for k in range(6):
        e.encode(["".join(f" {chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676 % 26)}{chr(97 + i // 17576 % 26)}" for i in range(70_000 * k, 70_000 * (k + 1)))])
    assert e.known.nbytes + e.flat.nbytes + e.ends.nbytes < 7_000_000
