"""A static range asymmetric numeral system (rANS) over a shared frequency table.

A block is cut in segments of at most SEGMENT symbols. A segment is coded by LANES interleaved states of 64 bits
that share one stream of 32-bit words; symbol i belongs to lane i modulo LANES. What stands before a segment's
words - its states and its number of words - is a checkpoint: any segment can be decoded on its own, and many
are decoded side by side, one numpy step for a symbol of each lane.

A block: MAGIC, scale bits, segments (u4 each), then for all segments symbols (u4), words (u4), states (u8), words.
"""

from __future__ import annotations

import struct

import numpy as np

LANES = 32
SEGMENT = 8192
LOW = np.uint64(1 << 31)
WORD = np.uint64(32)
MASK = np.uint64((1 << 32) - 1)
MAGIC = b"PLRA"
#: Segments coded side by side.
ABREAST = 256


class Table:
    """Frequencies that add up to 2 ** bits; each symbol that occurs has one at least."""

    def __init__(self, freq: np.ndarray, bits: int):
        self.bits, self.freq = bits, freq.astype(np.uint64)
        self.start = np.cumsum(self.freq) - self.freq
        self.limit = self.freq << np.uint64(63 - bits)
        self.pad = int(np.argmax(freq))
        self._slots: np.ndarray | None = None

    @property
    def slots(self) -> np.ndarray:
        if self._slots is None:
            self._slots = np.repeat(np.arange(len(self.freq), dtype=np.uint32), self.freq.astype(np.int64))
        return self._slots

    @staticmethod
    def of(counts: np.ndarray, bits: int = 20) -> Table:
        """From exact counts, by proportion; what rounding leaves goes to or comes from the most frequent."""
        counts = np.asarray(counts, np.int64)
        seen = counts > 0
        bits = max(bits, int(seen.sum()).bit_length() + 2)
        freq = np.zeros(len(counts), np.int64)
        if not seen.any():
            freq[:1] = 1 << bits
            return Table(freq, bits)
        freq[seen] = np.maximum(1, (counts[seen].astype(float) * (1 << bits) / counts.sum()).astype(np.int64))
        left = (1 << bits) - int(freq.sum())
        for s in np.argsort(-freq, kind="stable"):
            take = left if left > 0 else max(left, 1 - int(freq[s]))
            freq[s] += take
            left -= take
            if not left:
                break
        return Table(freq, bits)


def _order(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Segments from the longest on, and how many have a step t or more."""
    steps = -(-sizes // LANES)
    order = np.argsort(-steps, kind="stable")
    return order, np.searchsorted(-steps[order], -np.arange(steps.max(initial=0)), side="left")


def encode(blocks: list[np.ndarray], table: Table) -> list[bytes]:
    """The block of each array of ids. The segments of all blocks are coded side by side."""
    per = np.array([-(-len(x) // SEGMENT) for x in blocks], np.int64)
    number = np.arange(int(per.sum())) - np.repeat(np.cumsum(per) - per, per)
    sizes = np.minimum(SEGMENT, np.repeat([len(x) for x in blocks], per) - number * SEGMENT).astype(np.int64)
    ids = np.concatenate([*blocks, np.zeros(0, np.uint16)])
    begin = np.cumsum(sizes) - sizes
    states, words, counts = np.full((len(sizes), LANES), LOW, np.uint64), [b""] * len(sizes), np.zeros(len(sizes), np.int64)
    bits = np.uint64(table.bits)
    order, active = _order(sizes)
    for at in range(0, len(order), ABREAST):
        own = order[at : at + ABREAST]
        symbols = np.full((SEGMENT, len(own)), table.pad, np.int32)
        for i, k in enumerate(own.tolist()):
            symbols[: sizes[k], i] = ids[begin[k] : begin[k] + sizes[k]]
        symbols = symbols.reshape(SEGMENT // LANES, LANES, len(own))
        steps = -(-int(sizes[own[0]]) // LANES)
        x = np.full((LANES, len(own)), LOW, np.uint64)
        out, put = np.zeros((steps, LANES, len(own)), np.uint32), np.zeros((steps, LANES, len(own)), bool)
        for t in range(steps - 1, -1, -1):
            k = min(max(int(active[t]) - at, 0), len(own))
            s, y = symbols[t, :, :k], x[:, :k]
            f = table.freq[s]
            full = y >= table.limit[s]
            out[t, :, :k] = y.astype(np.uint32)  # the low 32 bits
            put[t, :, :k] = full
            y = np.where(full, y >> WORD, y)
            q = y // f
            x[:, :k] = (q << bits) + (y - q * f) + table.start[s]
        for i, k in enumerate(own.tolist()):
            w = out[:, :, i][put[:, :, i]]
            words[k], counts[k], states[k] = w.astype("<u4").tobytes(), len(w), x[:, i]
    made, last = [], 0
    for n in per.tolist():
        part = slice(last, last + n)
        last += n
        head = struct.pack("<4sII", MAGIC, table.bits, n)
        made.append(b"".join((head, sizes[part].astype("<u4").tobytes(), counts[part].astype("<u4").tobytes(), states[part].astype("<u8").tobytes(), *words[part])))
    return made


def _opened(block: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    magic, _, n = struct.unpack_from("<4sII", block)
    if magic != MAGIC:
        raise ValueError("not a block of token ids")
    sizes, counts = np.frombuffer(block, "<u4", n, 12).astype(np.int64), np.frombuffer(block, "<u4", n, 12 + 4 * n).astype(np.int64)
    states = np.frombuffer(block, "<u8", n * LANES, 12 + 8 * n).reshape(n, LANES)
    return sizes, counts, states, np.frombuffer(block, "<u4", int(counts.sum()), 12 + 8 * n + 8 * n * LANES)


def decode(blocks: list[bytes], table: Table) -> list[np.ndarray]:
    """The ids of each block. The segments of all blocks are decoded side by side."""
    if not blocks:
        return []
    opened = [_opened(b) for b in blocks]
    sizes, counts, states = (np.concatenate(x) for x in list(zip(*opened))[:3])
    words = np.concatenate([o[3] for o in opened] + [np.zeros(1, "<u4")]).astype(np.uint64)
    ids = np.zeros((len(sizes), SEGMENT), np.uint32)
    begin = np.cumsum(counts) - counts
    bits, low_bits = np.uint64(table.bits), np.uint64((1 << table.bits) - 1)
    order, active = _order(sizes)
    for at in range(0, len(order), ABREAST):
        own = order[at : at + ABREAST]
        x, reads = states[own].astype(np.uint64), begin[own]
        got = np.zeros((len(own), SEGMENT // LANES, LANES), np.uint32)
        for t in range(-(-int(sizes[own[0]]) // LANES)):
            k = min(max(active[t] - at, 0), len(own))
            y = x[:k]
            slot = y & low_bits
            s = table.slots[slot]
            got[:k, t] = s
            y = table.freq[s] * (y >> bits) + slot - table.start[s]
            need = y < LOW
            after = np.cumsum(need, axis=1)
            x[:k] = np.where(need, (y << WORD) | words[np.minimum(reads[:k, None] + after - need, len(words) - 1)], y)
            reads[:k] += after[:, -1]
        if (x != LOW).any() or (reads != begin[own] + counts[own]).any():
            raise ValueError("a block of token ids is damaged")
        ids[own] = got.reshape(len(own), SEGMENT)
    flat = ids[np.arange(SEGMENT) < sizes[:, None]]
    return np.split(flat, np.cumsum([int(o[0].sum()) for o in opened])[:-1])
