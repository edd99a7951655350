"""Corpora of token ids as files: documents in ascending doc_id order, in independent rANS blocks.

Below a path, ``freq`` holds the shared frequency table (id, freq) and ``blocks`` the blocks. A block holds whole
documents: part and block say where it stands (parts ascend with doc_id, blocks within a part), doc_ids and
doc_tokens list its documents, first_token counts the ids of the part before it, ids_crc32 is the checksum of its ids
(little-endian, 32 bits each) and payload the coded ids, see ans.py.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.llm.ans import Table, decode, encode
from plumbline.llm.common import arrow_map, slices, work_path, written
from plumbline.llm.tokens import SLICE, Encoder

#: Ids of a block, as a block ends with the document that reaches them; ids of a part, and most parts: beyond, they grow.
BLOCK, PART, PARTS = 1 << 16, 1 << 24, 20_000
#: Blocks coded side by side.
ABREAST_BLOCKS = 32


def encoded(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """(doc_id, n_tokens, ids, counts): whole texts as ids, end_id after each; ids are little-endian integers.

    Each task adds a row of its own whose counts (64 bits an id) say how often it used each id; they are null elsewhere.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.at_path(tokenizer)
        used = np.zeros(max(encoder.tokenizer.get_vocab_size(), end_id + 1), np.int64)
        names = ["doc_id", "n_tokens", "ids", "counts"]
        for b in batches:
            for s in slices(b.column(1), SLICE):
                ids, n = encoder.encode(b.column(1)[s.start : s.stop])
                ends = np.cumsum(n)
                ids = np.insert(ids, ends, end_id)
                n = n + 1
                used += np.bincount(ids, minlength=len(used))
                offsets = np.concatenate(([0], np.cumsum(n))).astype(np.int64) * ids.itemsize
                raw = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(ids)])
                yield pa.RecordBatch.from_arrays([b.column(0)[s.start : s.stop], pa.array(n), raw, pa.nulls(len(n), pa.binary())], names)
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([None], pa.int64()), pa.array([None], pa.binary()), pa.array([used.tobytes()], pa.binary())], names)

    return arrow_map(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, "doc_id long, n_tokens long, ids binary, counts binary")


def _dtype(tokenizer: str) -> np.dtype:
    return Encoder.at_path(tokenizer).dtype


def id_counts(ids: DataFrame) -> DataFrame:
    """(id, n) over all documents, from the tasks' counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for b in batches:
            for x in b.column(0):
                n = np.frombuffer(x.as_buffer(), np.int64)
                total = n.copy() if not len(total) else total + n
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int64)), pa.array(total[seen])], ["id", "n"])

    return arrow_map(ids.where("counts IS NOT NULL").select("counts"), run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def _coder(table: Table, dtype: np.dtype):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, block, before = TaskContext.get().partitionId(), 0, 0
        doc_ids: list[list[int | None]] = [[]]
        held: list[list[np.ndarray]] = [[]]
        waiting = 0

        def put() -> pa.RecordBatch:
            """The blocks that are held, coded side by side."""
            nonlocal block, before, doc_ids, held, waiting
            if not held[-1]:
                doc_ids.pop(), held.pop()
            ids = [np.concatenate(x) for x in held]
            n = [len(x) for x in ids]
            first = (np.cumsum(n) - n + before).tolist()
            crcs = [zlib.crc32(x.astype("<u4").tobytes()) for x in ids]
            cols = [[part] * len(n), list(range(block, block + len(n))), first, n, doc_ids, [[len(x) for x in docs] for docs in held], crcs, encode(ids, table)]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64(), pa.binary()]
            block, before, doc_ids, held, waiting = block + len(n), before + sum(n), [[]], [[]], 0
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(cols, kinds)], ["part", "block", "first_token", "n_tokens", "doc_ids", "doc_tokens", "ids_crc32", "payload"])

        for b in batches:
            for doc_id, x in zip(b.column(0).to_pylist(), b.column(1)):
                doc_ids[-1].append(doc_id)
                held[-1].append(np.frombuffer(x.as_buffer(), dtype))
                waiting += len(held[-1][-1])
                if waiting >= BLOCK:
                    doc_ids.append([])
                    held.append([])
                    waiting = 0
                    if len(held) > ABREAST_BLOCKS:
                        yield put()
        if len(held) > 1 or held[-1]:
            yield put()

    return run


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2) -> None:
    """Writes all whole texts of docs (doc_id, text) as token ids below path.

    A null text counts as empty and gives the end id alone. Rows without a doc_id come first; rows that repeat a
    doc_id all stand, in the order of their ids' bytes. Texts of any length are encoded whole. Extra columns, whatever
    their names, play no part. An empty table gives files without blocks.
    """
    spark, dtype = docs.sparkSession, _dtype(tokenizer)
    ids = written(encoded(docs, tokenizer, end_id), "token-ids")
    found = id_counts(ids).collect()  # as many rows as the vocabulary has ids, at most
    counts = np.zeros(max((r["id"] for r in found), default=0) + 1, np.int64)
    for r in found:
        counts[r["id"]] = r["n"]
    table = Table.of(counts)
    freq = [(int(i), int(table.freq[i])) for i in np.flatnonzero(table.freq)]
    spark.createDataFrame(freq, "id long, freq long").coalesce(1).write.parquet(f"{path}/freq")
    parts = min(PARTS, max(1, -(-int(counts.sum()) // PART)))
    ordered = ids.where("counts IS NULL").select("doc_id", "n_tokens", "ids").repartitionByRange(parts, "doc_id", "n_tokens").sortWithinPartitions("doc_id", "n_tokens", "ids")
    blocks = arrow_map(ordered.select("doc_id", "ids"), _coder(table, dtype), "part int, block int, first_token long, n_tokens long, doc_ids array<long>, doc_tokens array<long>, ids_crc32 long, payload binary")
    blocks.write.option("compression", "zstd").parquet(f"{path}/blocks")


def read(spark: SparkSession, path: str, *, with_ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids]) of every document below path, decoded in parallel and checked."""
    blocks = spark.read.parquet(f"{path}/blocks")
    freq = spark.read.parquet(f"{path}/freq").collect()  # bounded by the vocabulary
    top = np.zeros(max((r["id"] for r in freq), default=0) + 1, np.int64)
    for r in freq:
        top[r["id"]] = r["freq"]
    table = Table(top, int(top.sum()).bit_length() - 1)
    sums = blocks.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    bases = sums.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"))  # a row a part
    placed = blocks.join(bases, "part").select((F.col("base") + F.col("first_token")).alias("start"), "doc_ids", "doc_tokens", "ids_crc32", "payload")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, len(b), ABREAST_BLOCKS):
                rows = b.slice(at, ABREAST_BLOCKS).to_pylist()
                for row, ids in zip(rows, decode([r["payload"] for r in rows], table)):
                    raw = ids.astype("<u4").tobytes()
                    if zlib.crc32(raw) != row["ids_crc32"]:
                        raise ValueError("a block of token ids fails its checksum")
                    ends = np.cumsum(np.array(row["doc_tokens"], np.int64))
                    begins = ends - row["doc_tokens"]
                    crcs = [zlib.crc32(raw[4 * a : 4 * e]) for a, e in zip(begins.tolist(), ends.tolist())]
                    cols = [pa.array(row["doc_ids"], pa.int64()), pa.array(row["start"] + begins), pa.array(ends - begins), pa.array(crcs, pa.int64())]
                    if with_ids:
                        cols.append(pa.array([ids[a:e] for a, e in zip(begins, ends)], pa.list_(pa.int64())))
                    yield pa.RecordBatch.from_arrays(cols, ["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(cols)])

    return arrow_map(placed, run, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids)


def op5(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Rows of op5_token_ids_rans: written, then read back from the files."""
    path = work_path(docs.sparkSession, "token-files")
    write(docs, path, tokenizer)
    return read(docs.sparkSession, path)
