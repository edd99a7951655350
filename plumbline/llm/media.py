"""Audio: texts as 8-bit sound, and features of sound.

A stored form is a WAV file of 8-bit samples, one channel, RATE samples a second. Features: polyphase resampling to
RATE * UP / DOWN, log-mel energies of overlapping frames, and spans of activity by hysteresis - a span begins where the
frame energy rises above the upper threshold and ends where it falls below the lower one. The frames of each span are
cut in patches of PATCH frames, the last one padded with zeros, and stored as a fixed-shape Arrow tensor column with
the time of each patch, in the Arrow IPC stream format.

All is computed file by file and, within a long file, by blocks of a fixed number of frames, so what a file gives does
not depend on its neighbours, and memory is bounded by the file.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import arrow_map, slices, written

RATE, UP, DOWN = 16_000, 1, 2
#: Taps of the low-pass filter a phase; at the new rate, samples of a frame and from one frame to the next; mel bands; frames of a patch.
TAPS, FRAME, HOP, FFT, MELS, PATCH = 24, 200, 80, 256, 24, 64
UNIT = 192
FRAMES_AT_ONCE = 4096


def payload(text: str | None) -> tuple[int, bytes]:
    """The UTF-8 bytes of a text and their number, with spaces up to a positive multiple of UNIT."""
    raw = (text or "").encode()
    return len(raw), raw.ljust(max(1, -(-len(raw) // UNIT)) * UNIT, b" ")


def wav(samples: bytes, rate: int = RATE) -> bytes:
    """A RIFF file of unsigned 8-bit samples, one channel."""
    pad = b"\0" * (len(samples) % 2)
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(samples) + len(pad), b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", len(samples)) + samples + pad


def samples_of(file: bytes) -> tuple[int, bytes]:
    """Rate and samples of an 8-bit WAV file with one channel."""
    if file[:4] != b"RIFF" or file[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, rate = 12, None
    while at + 8 <= len(file):
        kind, n = struct.unpack_from("<4sI", file, at)
        if kind == b"fmt ":
            form, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", file, at + 8)
            if (form, channels, bits) != (1, 1, 8):
                raise ValueError("not 8-bit sound of one channel")
        elif kind == b"data":
            if rate is None or at + 8 + n > len(file):
                raise ValueError("a damaged WAV file")
            return rate, file[at + 8 : at + 8 + n]
        at += 8 + n + n % 2
    raise ValueError("a WAV file without samples")


def _filter(up: int, down: int) -> np.ndarray:
    """Taps of a windowed sinc for a change of rate by up / down, a row a phase."""
    n = TAPS * up
    t = np.arange(n) - (n - 1) / 2
    cut = 1 / max(up, down)
    h = cut * np.sinc(cut * t) * np.hamming(n)
    return (h * up / h.sum()).reshape(TAPS, up).T.astype(np.float32)


def resample(x: np.ndarray, up: int = UP, down: int = DOWN) -> np.ndarray:
    """x at up / down of its rate: each phase of the filter meets only the samples that are not padding."""
    phases = _filter(up, down)
    n = -(-len(x) * up // down)
    padded = np.concatenate((np.zeros(TAPS // 2, np.float32), x.astype(np.float32), np.zeros(TAPS, np.float32)))
    out = np.zeros(n, np.float32)
    for first in range(min(up, n)):  # outputs at first, first + up, ... use one phase and samples a fixed step apart
        phase, at = first * down % up, first * down // up
        m = len(range(first, n, up))
        y = np.zeros(m, np.float32)
        for k in range(TAPS):
            part = padded[at + k : at + k + (m - 1) * down + 1 : down]
            y[: len(part)] += phases[phase, TAPS - 1 - k] * part
        out[first::up] = y
    return out


def mel_bank(rate: float, fft: int = FFT, bands: int = MELS, low: float = 60.0) -> np.ndarray:
    """(bins, bands): triangles evenly spaced in mel."""
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = 700 * (10 ** (np.linspace(mel(low), mel(rate / 2), bands + 2) / 2595) - 1)
    f = np.fft.rfftfreq(fft, 1 / rate)[:, None]
    left, mid, right = edges[:-2], edges[1:-1], edges[2:]
    return np.maximum(0, np.minimum((f - left) / (mid - left), (right - f) / (right - mid))).astype(np.float32)


_WINDOW = np.hanning(FRAME).astype(np.float32)


def log_mels(x: np.ndarray, rate: float) -> tuple[np.ndarray, np.ndarray]:
    """(frames, MELS) log energies and the log energy of each frame; a last frame is padded with zeros."""
    n = 1 + max(0, -(-(len(x) - FRAME) // HOP))
    padded = np.concatenate((x, np.zeros((n - 1) * HOP + FRAME - len(x), np.float32)))
    frames = np.lib.stride_tricks.sliding_window_view(padded, FRAME)[::HOP]
    bank, mels, energy = mel_bank(rate), [], []
    for at in range(0, n, FRAMES_AT_ONCE):
        part = frames[at : at + FRAMES_AT_ONCE] * _WINDOW
        power = np.abs(np.fft.rfft(part, FFT, axis=1)) ** 2
        mels.append(np.log(power.astype(np.float32) @ bank + 1e-6))
        energy.append(np.log((part.astype(np.float64) ** 2).mean(axis=1) + 1e-9))
    return np.concatenate(mels).astype(np.float32), np.concatenate(energy)


def active(energy: np.ndarray, width: float = 0.5) -> list[tuple[int, int]]:
    """Spans of frames by hysteresis around the mean energy, width standard deviations up and down."""
    mean, spread = energy.mean(), energy.std()
    event = np.where(energy > mean + width * spread, 1, np.where(energy < mean - width * spread, -1, 0))
    last = np.maximum.accumulate(np.where(event != 0, np.arange(len(event)), -1))
    on = (last >= 0) & (event[last] == 1)
    edges = np.flatnonzero(np.diff(np.concatenate(([0], on.astype(np.int8), [0]))))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist()))


def tensor_stream(file: bytes) -> tuple[bytes, int, list[tuple[float, float]]]:
    """The features of a WAV file: an Arrow stream of patches, the number of frames, and the spans in milliseconds."""
    rate, raw = samples_of(file)
    x = (np.frombuffer(raw, np.uint8).astype(np.float32) - 128) / 128
    new = rate * UP / DOWN
    mels, energy = log_mels(resample(x), new)
    ms = 1000 / new
    spans, patches, times = active(energy), [], []
    for b, e in spans:
        for p in range(b, e, PATCH):
            patch = np.zeros((PATCH, MELS), np.float32)
            part = mels[p : min(p + PATCH, e)]
            patch[: len(part)] = part
            patches.append(patch)
            times.append((p * HOP * ms, ((p + len(part) - 1) * HOP + FRAME) * ms))
    flat = np.stack(patches) if patches else np.zeros((0, PATCH, MELS), np.float32)
    kind = pa.fixed_shape_tensor(pa.float32(), (PATCH, MELS))
    values = pa.FixedSizeListArray.from_arrays(pa.array(flat.reshape(-1)), PATCH * MELS)
    batch = pa.RecordBatch.from_arrays([pa.array([t[0] for t in times], pa.float64()), pa.array([t[1] for t in times], pa.float64()), pa.ExtensionArray.from_storage(kind, values)], ["start_ms", "end_ms", "log_mel"])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes(), len(energy), [(b * HOP * ms, ((e - 1) * HOP + FRAME) * ms) for b, e in spans]


def stored(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): every whole text as a WAV file, written to the shared folder and read back.

    A null text counts as empty. Rows that repeat, or have no doc_id, are stored row by row. A very long text is one long
    file. Extra columns, whatever their names, play no part. An empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in slices(b.column(1)):
                made = [payload(t) for t in b.column(1)[s.start : s.stop].to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column(0)[s.start : s.stop], pa.array([n for n, _ in made], pa.int64()), pa.array([wav(p) for _, p in made], pa.binary())], ["doc_id", "n_bytes", "media"])

    return written(arrow_map(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, "doc_id long, n_bytes long, media binary"), "media")


def features(media: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, frames, spans, tensors) of stored files.

    tensors is an Arrow IPC stream of start_ms, end_ms and log_mel, a fixed-shape tensor of PATCH x MELS; spans are
    those of activity, in milliseconds. Each row is judged alone, so repeated rows and rows without a doc_id give what
    their file gives; a file that is no 8-bit WAV file of one channel is refused. An empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in slices(b.column(2), 2_000_000):
                files = b.column(2)[s.start : s.stop].to_pylist()
                raws = [samples_of(f)[1] for f in files]
                made = [tensor_stream(f) for f in files]
                spans = pa.array([[{"start_ms": x, "end_ms": y} for x, y in m[2]] for m in made], pa.list_(pa.struct([("start_ms", pa.float64()), ("end_ms", pa.float64())])))
                cols = [
                    b.column(0)[s.start : s.stop],
                    b.column(1)[s.start : s.stop],
                    pa.array([len(r) for r in raws], pa.int64()),
                    pa.array([hashlib.sha256(r).hexdigest() for r in raws]),
                    pa.array([zlib.crc32(r[-16:]) for r in raws], pa.int64()),
                    pa.array([len(f) for f in files], pa.int64()),
                    pa.array([hashlib.sha256(f).hexdigest() for f in files]),
                    pa.array([m[1] for m in made], pa.int64()),
                    spans,
                    pa.array([m[0] for m in made], pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "frames", "spans", "tensors"])

    return arrow_map(media, run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, frames long, spans array<struct<start_ms: double, end_ms: double>>, tensors binary")


def op4(docs: DataFrame) -> DataFrame:
    """Rows of op4_audio_features; feature names the frames, the spans and a digest of the tensors."""
    feature = F.concat_ws(":", F.col("frames").cast("string"), F.size("spans").cast("string"), F.sha2("tensors", 256))
    return features(stored(docs)).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", feature.alias("feature"))
