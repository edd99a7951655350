"""Whole texts to token ids with a tokenizers file, and how many tokens each section of a text gets."""

from __future__ import annotations

import json
import os
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core; read when the library first encodes

from pyspark.sql import DataFrame  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402
from tokenizers import Encoding, Tokenizer  # noqa: E402

from plumbline.llm.common import arrow_map, slices  # noqa: E402

#: Bytes of text encoded at once, and with offsets; a longer text goes by parts where its tokenizer allows, so memory
#: doesn't grow with it.
SLICE = AT_ONCE = 2_000_000
WHOLE = 1_000_000
#: What a worker remembers: pieces, their ids in total, and the bytes of the longest piece.
HELD, HELD_IDS, LONGEST = 200_000, 2_000_000, 64
#: Bytes of new pieces encoded as one string.
JOINED = 1 << 14
#: Kinds of characters: unknown, letter, digit, other visible ASCII, apostrophe, white space. Of letters beyond ASCII those
#: of two bytes are known whose first byte is C3 to C9 (without the signs of times and division), D0 or D1.
_LETTER, _DIGIT, _SIGN, _APOSTROPHE, _WHITE = range(1, 6)
_KIND, _LEADS = np.zeros(256, np.uint8), np.zeros(256, bool)
_KIND[33:127] = _SIGN
_KIND[[*range(65, 91), *range(97, 123)]] = _LETTER
_KIND[48:58] = _DIGIT
_KIND[39] = _APOSTROPHE
_KIND[[*range(9, 14), 32]] = _WHITE
_LEADS[[*range(0xC3, 0xCA), 0xD0, 0xD1]] = True
#: Kinds side by side that no match of the usual pattern joins; an apostrophe may begin one with what follows.
_APART = np.zeros((6, 8), bool)
for _k in (_LETTER, _DIGIT, _SIGN):
    _APART[_k, [x for x in (_LETTER, _DIGIT, _SIGN) if x != _k]] = True
_APART[[_LETTER, _DIGIT], _APOSTROPHE] = True
_APART[1:_WHITE, _WHITE] = True
_APART = _APART.ravel()
_encoders: dict[str, Encoder] = {}


def _runs(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each run, end to end."""
    return np.repeat(start - (np.cumsum(length) - length), length) + np.arange(int(length.sum()))


def _is_space(b: np.ndarray) -> np.ndarray:
    return (b == 32) | ((b >= 9) & (b <= 13)) | ((b >= 28) & (b <= 31))


class Encoder:
    """Encodes whole texts.

    A byte-level tokenizer that cuts words by the usual pattern never joins the characters on both sides of a
    space between two non-spaces, nor a letter, a digit and a sign, nor what is visible and white space behind it, so its
    ids are those of the pieces that begin at such places; a word is then the same piece with a comma, a line's end or
    nothing behind it. Equal pieces of a part of the texts are encoded once, and a worker remembers a bounded number of
    short ones, those that it met last; pieces are compared byte by byte. A text without such places is one piece and
    remembered nowhere. Other tokenizers encode each text in one go.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.tokenizer = Tokenizer.from_file(path)
        pre = spec.get("pre_tokenizer") or {}
        byte_level = spec.get("normalizer") is None and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space")
        self.by_piece = byte_level and pre.get("use_regex", True) and not any(a["lstrip"] or a["rstrip"] or a["single_word"] or " " in a["content"] for a in spec["added_tokens"])
        self.added = [a["content"].encode() for a in spec["added_tokens"]]
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.tiling = self.by_piece and spec.get("post_processor") is None
        self.lengths = self._byte_lengths() if self.by_piece else None
        #: Pieces, their ids end to end and where these end, the part in which a piece was last met, and the parts so far.
        self.known, self.flat, self.ends = pa.array([], pa.large_binary()), np.zeros(0, self.dtype), np.zeros(1, np.int64)
        self.met, self.parts = np.zeros(0, np.int64), 0

    @staticmethod
    def at_path(path: str) -> Encoder:
        """One for each worker and path."""
        if path not in _encoders:
            _encoders[path] = Encoder(path)
        return _encoders[path]

    def _batch(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of texts end to end, and how many each has."""
        ids, n = array("I"), []
        for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False):
            ids.fromlist(e.ids)
            n.append(len(ids))
        return np.array(ids).astype(self.dtype), np.diff(np.array([0, *n], np.int64))

    @staticmethod
    def _bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of texts end to end, as they lie there, and how many each has."""
        sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
        data, offsets = texts.buffers()[2], np.frombuffer(texts.buffers()[1], np.int32 if texts.type == pa.string() else np.int64)
        low = int(offsets[texts.offset])
        return np.frombuffer(data, np.uint8)[low : low + int(sizes.sum())] if data else np.zeros(0, np.uint8), sizes

    def encode(self, texts: pa.Array | list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts end to end, and how many each has; null counts as empty."""
        texts = (texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())).fill_null("")
        if not self.by_piece:
            return self._batch(texts.to_pylist())
        b, sizes = self._bytes(texts)
        begin = np.cumsum(sizes) - sizes
        cuts = np.append(self._cuts(b, begin[sizes > 0]), len(b))
        ids, counts, i = [np.zeros(0, self.dtype)], [np.zeros(0, np.int64)], 0
        while i < len(cuts) - 1:
            j = max(i + 1, int(np.searchsorted(cuts, cuts[i] + AT_ONCE, "right")) - 1)
            for out, part in zip((ids, counts), self._part(b[cuts[i] : cuts[j]], cuts[i : j + 1] - cuts[i])):
                out.append(part)
            i = j
        total = np.concatenate(([0], np.cumsum(np.concatenate(counts))))
        return np.concatenate(ids), np.diff(total[np.append(np.searchsorted(cuts, begin), len(cuts) - 1)])

    def _cuts(self, b: np.ndarray, begin: np.ndarray) -> np.ndarray:
        """Where pieces begin: at each text's begin, at spaces whose neighbours in the text are no white space, where one kind
        of character follows another, and behind single white space other than a space; never within an added token."""
        n = len(b)
        p = np.flatnonzero(b == 32)
        edge = np.zeros(n + 1, bool)
        edge[begin] = True
        edge[n] = True
        p = p[~edge[p] & ~edge[p + 1]]
        before, after = b[p - 1], b[p + 1]
        # C2 and E1 to E3 lead all white space beyond ASCII, and much else that is left uncut here.
        loose = _is_space(before) | _is_space(after) | (after == 0xC2) | ((after >= 0xE1) & (after <= 0xE3))
        wide = before >= 0x80
        third = b[np.maximum(p - 3, 0)]
        loose |= wide & ((b[np.maximum(p - 2, 0)] == 0xC2) | ((third >= 0xE1) & (third <= 0xE3)))
        edge[p[~loose]] = True
        kind = _KIND[b]
        lead = np.flatnonzero(_LEADS[b])
        lead = lead[(b[lead] != 0xC3) | (b[lead + 1] != 0x97) & (b[lead + 1] != 0xB7)]
        kind[lead] = kind[lead + 1] = _LETTER
        edge[1:n] |= _APART[(kind[:-1] << 3) + kind[1:]]
        p = np.flatnonzero((kind == _WHITE) & (b != 32))
        p = p[(p > 0) & (p < n - 1)]
        seen = (kind > 0) & (kind < _WHITE)
        edge[p[seen[p - 1] & seen[p + 1]] + 1] = True
        if self.added:
            raw, inside = b.tobytes(), []
            for token in self.added:
                at = raw.find(token)
                while at >= 0:
                    inside.append((at + 1, at + len(token)))
                    at = raw.find(token, at + 1)
            for x, y in inside:
                edge[x:y] = False
            edge[begin] = True
        return np.flatnonzero(edge[:n])

    def _part(self, b: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the pieces between cuts, end to end, and how many each piece has."""
        pieces = pa.Array.from_buffers(pa.large_binary(), len(cuts) - 1, [None, pa.py_buffer(cuts.astype(np.int64)), pa.py_buffer(b)])
        old = len(self.known)
        coded = pa.concat_arrays([self.known, pieces]).dictionary_encode()  # what is known keeps its place
        of = coded.indices.to_numpy()[old:]
        ids, n = self._fresh(coded.dictionary[old:])
        pool, ends = np.concatenate((self.flat, ids)), np.concatenate((self.ends, self.ends[-1] + np.cumsum(n)))
        self.met = np.concatenate((self.met, np.zeros(len(n), np.int64)))
        self.met[of] = self.parts = self.parts + 1
        self._remember(coded.dictionary, pool, ends)
        size = np.diff(ends)[of]
        return pool[_runs(ends[of], size)], size

    def _fresh(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of different pieces, and how many each has.

        Pieces that begin with a space and go on with no white space can follow any piece in a text, so many of them are
        encoded as one string; the bytes that each id stands for say where a piece ends.
        """
        size = pc.binary_length(pieces).to_numpy(zero_copy_only=False).astype(np.int64)
        at = np.frombuffer(pieces.buffers()[1], np.int64)[pieces.offset : pieces.offset + len(pieces) + 1]
        b = np.frombuffer(pieces.buffers()[2], np.uint8)[at[0] : at[-1]] if len(pieces) else np.zeros(0, np.uint8)
        begin = np.cumsum(size) - size
        after = b[np.minimum(begin + 1, len(b) - 1)]
        follows = (b[begin] == 32) & (size > 1) & ((_KIND[after] % _WHITE > 0) | (after > 0xC2) & ((after < 0xE1) | (after > 0xE3)))
        order = np.argsort(follows, kind="stable")  # those that can't follow any other, each a string, then the others
        text = b[_runs(begin[order], size[order])].tobytes()
        ends = np.cumsum(size[order])
        alone = int(np.count_nonzero(~follows))
        joined = ends[alone:]
        first = int(ends[alone - 1]) if alone else 0
        cuts = np.unique(joined[np.flatnonzero(np.diff(np.append((joined - first) // JOINED, -1)))])
        cut = [0, *ends[:alone].tolist(), *cuts.tolist()]
        ids, _ = self._batch([text[x:y].decode() for x, y in zip(cut, cut[1:])])
        n = np.diff(np.searchsorted(np.cumsum(self.lengths[ids]), np.concatenate(([0], ends)), "right")) if len(ids) else np.zeros(len(size), np.int64)
        back = np.empty_like(order)
        back[order] = np.arange(len(order))
        return ids[_runs((np.cumsum(n) - n)[back], n[back])], n[back]

    def _byte_lengths(self) -> np.ndarray:
        """UTF-8 bytes that each id stands for."""
        special = {i: len(a.content.encode()) for i, a in self.tokenizer.get_added_tokens_decoder().items()}
        return np.array([special.get(i, len(self.tokenizer.id_to_token(i) or "")) for i in range(self.tokenizer.get_vocab_size())], np.int64)

    def _remember(self, pieces: pa.Array, pool: np.ndarray, ends: np.ndarray) -> None:
        """Keeps the short ones of pieces; where they are too many, half as many as may be, and those that were met last."""
        n = np.diff(ends)
        keep = np.flatnonzero(pc.binary_length(pieces).to_numpy(zero_copy_only=False) <= LONGEST)
        if len(keep) > HELD or int(n[keep].sum()) > HELD_IDS:
            keep = keep[np.argsort(-self.met[keep], kind="stable")][: HELD // 2]
            keep = np.sort(keep[np.cumsum(n[keep]) <= HELD_IDS // 2])
        if len(keep) < len(n):
            pieces, pool, ends, self.met = pieces.take(pa.array(keep)), pool[_runs(ends[keep], n[keep])], np.concatenate(([0], np.cumsum(n[keep]))), self.met[keep]
        self.known, self.flat, self.ends = pieces, pool, ends

    def spans(self, texts: list[str]) -> list[np.ndarray]:
        """(tokens, 2): start and end of each token of each text in code points, the tokenizer's offsets.

        Whole texts are encoded; one of more than WHOLE bytes by parts of whole pieces, which gives the same tokens.
        """
        parts, of = [], []
        for i, text in enumerate(texts):
            raw = text.encode() if self.by_piece and len(text) > WHOLE else b""
            cuts = np.append(self._cuts(np.frombuffer(raw, np.uint8), np.zeros(1, np.int64)), len(raw)) if raw else np.zeros(0, np.int64)
            at, shift = 0, 0
            while raw and at < len(cuts) - 1:
                to = max(at + 1, int(np.searchsorted(cuts, cuts[at] + WHOLE, "right")) - 1)
                parts.append(raw[cuts[at] : cuts[to]].decode())
                of.append((i, shift))
                at, shift = to, shift + len(parts[-1])
            if not raw:
                parts.append(text)
                of.append((i, 0))
        out: list[list[np.ndarray]] = [[] for _ in texts]
        held, at = 0, 0
        for k, part in enumerate(parts):  # as many at once as a slice holds
            held += len(part)
            if held >= WHOLE or k == len(parts) - 1:
                for (i, shift), found in zip(of[at : k + 1], self._offsets(parts[at : k + 1])):
                    out[i].append(found + shift)
                held, at = 0, k + 1
        return [x[0] if len(x) == 1 else np.concatenate(x) for x in out]

    def _offsets(self, texts: list[str]) -> list[np.ndarray]:
        """The tokenizer's offsets of each text, (tokens, 2).

        The tokens of a byte-level tokenizer without a post-processor tile the text's bytes, so the bytes that each id
        stands for say where its token is, and a token of part of a character has that character's offsets. Where the bytes
        don't add up to the text's, and with other tokenizers, the library is asked for offsets.
        """
        if not self.tiling:
            return [self._asked(e) for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]
        out = []
        for text, e in zip(texts, self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)):
            edge = np.zeros(len(e) + 1, np.int64)
            np.cumsum(self.lengths[np.array(e.ids, np.int64)], out=edge[1:])
            b = np.frombuffer(text.encode(), np.uint8)
            if edge[-1] != len(b):
                out.append(self._asked(self.tokenizer.encode(text, add_special_tokens=False)))
            elif len(b) == len(text):
                out.append(np.stack((edge[:-1], edge[1:]), axis=1))
            else:
                of = np.cumsum((b & 0xC0) != 0x80) - 1  # the code point of each byte
                out.append(np.stack((of[edge[:-1]], of[edge[1:] - 1] + 1), axis=1))
        return out

    def sections(self, texts: pa.Array, cut_after: str) -> list[np.ndarray]:
        """(text, number in the text, start and end in code points, tokens, tokens of the text) of each section of texts.

        Whole texts are encoded. Where their tokens tile their bytes, the bytes of all texts are looked at side by side,
        and code points are asked for at sections' edges and of tokens that cross one only; else text by text.
        """
        b, sizes = self._bytes(texts)
        if self.tiling and int(sizes.max()) <= WHOLE:
            ids, n = self._batch(texts.to_pylist())
            edge = np.zeros(len(ids) + 1, np.int64)
            np.cumsum(self.lengths[ids], out=edge[1:])
            if (edge[np.cumsum(n)] == np.cumsum(sizes)).all() and (edge[1:] > edge[:-1]).all():
                return _tiled_sections(b, sizes, edge, n, cut_after.encode())
        out = []
        for i, (text, spans) in enumerate(zip(own := texts.to_pylist(), self.spans(own))):
            chars = np.frombuffer(text.encode("utf-32-le"), np.uint32)
            cuts = np.concatenate(([0], np.flatnonzero(chars[:-1] == ord(cut_after)) + 1, [len(chars)]))
            counts = attribute(spans[:, 0], spans[:, 1], cuts) if text else np.zeros(1, np.int64)
            k = len(counts)
            out.append((np.full(k, i), np.arange(k), cuts[:-1], cuts[1:], counts, np.full(k, counts.sum())))
        return [np.concatenate(x).astype(np.int64) for x in zip(*out)]

    @staticmethod
    def _asked(e: Encoding) -> np.ndarray:
        return np.fromiter(chain.from_iterable(e.offsets), np.int64, 2 * len(e)).reshape(-1, 2)


def attribute(starts: np.ndarray, ends: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Tokens that each section gets; sections run from one cut to the next, tokens are in ascending order.

    A merge join of the two interval lists. A token within one section counts there. One that crosses a cut
    counts for the section with most of its code points, on a tie for the earlier one.
    """
    n = len(cuts) - 1
    first = np.clip(np.searchsorted(cuts, starts, side="right") - 1, 0, max(n - 1, 0))
    last = np.clip(np.searchsorted(cuts, ends, side="left") - 1, 0, max(n - 1, 0))
    best = first.copy()
    for i in np.flatnonzero(last > first):
        over = [min(ends[i], cuts[k + 1]) - max(starts[i], cuts[k]) for k in range(first[i], last[i] + 1)]
        best[i] = first[i] + int(np.argmax(over))
    return np.bincount(best, minlength=n) if n else np.zeros(0, np.int64)


def _tiled_sections(b: np.ndarray, sizes: np.ndarray, edge: np.ndarray, n: np.ndarray, cut: bytes) -> list[np.ndarray]:
    """Encoder.sections of texts that lie end to end in b, with n tokens each; token t is b[edge[t] : edge[t + 1]]."""
    end = np.cumsum(sizes)
    begin = end - sizes
    hit = b == cut[0]
    for k in range(1, len(cut)):
        hit[:-k] &= b[k:] == cut[k]
        hit[-k:] = False
    at = np.flatnonzero(hit) + len(cut)
    text = np.searchsorted(end, at, "right")
    inner = at > begin[np.minimum(text, len(end) - 1)]  # else it is where a text ends
    at, text = at[inner & (text < len(end))], text[inner & (text < len(end))]
    lo, of = np.concatenate((begin, at)), np.concatenate((np.arange(len(sizes)), text))
    order = np.lexsort((lo, of))
    lo, of = lo[order], of[order]
    first = np.searchsorted(of, np.arange(len(sizes)))  # section of each text
    hi = np.append(lo[1:], 0)
    hi[np.append(first[1:], len(of)) - 1] = end
    counts = np.searchsorted(edge[:-1], hi) - np.searchsorted(edge[:-1], lo)  # by where a token begins
    seen = np.concatenate(([0], np.cumsum((b & 0xC0) != 0x80)))  # code points that begin before a byte
    token = np.searchsorted(edge[:-1], at) - 1
    for t in np.unique(token[edge[token + 1] > at]).tolist():
        x, y = int(edge[t]), int(edge[t + 1])
        i = int(np.searchsorted(lo, x, "right")) - 1
        j = int(np.searchsorted(lo, y, "left"))
        start, stop = seen[x + 1] - 1, seen[y]  # of part of a character, that character's
        best = i + int(np.argmax(np.minimum(stop, seen[hi[i:j]]) - np.maximum(start, seen[lo[i:j]])))
        counts[i] -= 1
        counts[best] += 1
    shift = seen[begin[of]]
    return [of, np.arange(len(of)) - first[of], seen[lo] - shift, seen[hi] - shift, counts, n[of]]


def section_counts(docs: DataFrame, tokenizer: str, *, cut_after: str = "\n") -> DataFrame:
    """(doc_id, section, char_start, char_end, n_tokens, doc_tokens): tokens of each section of each whole text.

    A section ends after each cut_after (one character) and at the end of the text, so sections tile the text and
    their counts add up to the document's. Each document is encoded once, as a whole, and its sections are joined with
    the tokenizer's own offsets. A null or empty text has one empty section without tokens. Repeated rows, and rows with
    a null doc_id, count row by row. A very long text goes by parts that give the same tokens. Needs doc_id and text;
    other columns, whatever their names, play no part. An empty table gives an empty result.
    """
    if len(cut_after) != 1:
        raise ValueError("cut_after is one character")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.at_path(tokenizer)
        for b in batches:
            for s in slices(b.column(1), WHOLE):
                of, number, *rest = encoder.sections(b.column(1)[s.start : s.stop].fill_null(""), cut_after)
                yield pa.RecordBatch.from_arrays([pc.take(b.column(0)[s.start : s.stop], pa.array(of)), pa.array(number.astype(np.int32)), *map(pa.array, rest)], ["doc_id", "section", "char_start", "char_end", "n_tokens", "doc_tokens"])

    return arrow_map(docs.select("doc_id", F.col("text").cast("string")), run, f"doc_id {dict(docs.dtypes)['doc_id']}, section int, char_start long, char_end long, n_tokens long, doc_tokens long")
