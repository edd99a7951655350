"""Product codes of vectors: weighted Lloyd over the different integer parts of each position.

Components become integers, so equal parts are equal rows: a position's parts are counted once each, and all rounds run
over these weighted distinct rows. A task assigns its rows to the nearest entries and gives one sum a used entry, at most
entries x positions rows a task, which combine into the next codebooks; those, and they alone, come to the driver. At the
end each distinct part's code and error are joined back to the vectors that hold it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import arrow_map, written

SCALE, PARTS, ENTRIES, ROUNDS = 1024, 4, 256, 4
#: Integer components lie within this, so that squared distances of 512 components a part fit in 64 bits.
LIMIT = 1 << 26
#: Distances looked at together in a task.
AT_ONCE = 1 << 22


def _finite(v: str) -> Column:
    """Whether a vector is there and all its components are finite; NaN counts as larger than infinity."""
    return F.col(v).isNotNull() & F.forall(v, lambda x: x.isNotNull() & (F.abs(x) < F.lit(float("inf"))))


def _integers(v: str) -> Column:
    whole = lambda x: F.floor(F.greatest(F.least(x.cast("double") * SCALE, F.lit(float(LIMIT))), F.lit(float(-LIMIT)))).cast("int")
    return F.transform(v, whole)


def nearest(parts: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each row of parts the nearest row of a codebook, the first on a tie, and its squared distance; exact."""
    code, error = np.zeros(len(parts), np.int64), np.zeros(len(parts), np.int64)
    if not parts.shape[1]:
        return code, error
    top = max(int(np.abs(parts).max(initial=0)), int(np.abs(book).max(initial=0)))
    small = 4 * parts.shape[1] * top * top < 1 << 52  # then doubles hold all terms exactly
    for at in range(0, len(parts), max(1, AT_ONCE // len(book) // (1 if small else parts.shape[1]))):
        x = parts[at : at + max(1, AT_ONCE // len(book) // (1 if small else parts.shape[1]))]
        if small:
            d = (x.astype(float) ** 2).sum(1)[:, None] - 2 * (x.astype(float) @ book.astype(float).T) + (book.astype(float) ** 2).sum(1)
        else:
            d = ((x[:, None, :] - book[None, :, :]) ** 2).sum(2)
        code[at : at + len(x)] = best = d.argmin(1)
        error[at : at + len(x)] = d[np.arange(len(x)), best]
    return code, error


def _matrix(b: pa.RecordBatch, name: str) -> np.ndarray:
    own = b.column(b.schema.get_field_index(name))
    return own.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(b), -1)


def _by_position(b: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
    position = b.column(b.schema.get_field_index("position")).to_numpy()
    for p in np.unique(position).tolist():
        yield p, np.flatnonzero(position == p)


def _sums(books: list[np.ndarray]):
    """Of a task's (position, part, weight) the used entries' weights and weighted sums: (position, entry, weight, total)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight = [np.zeros(len(x), np.int64) for x in books]
        total = [np.zeros(x.shape, np.int64) for x in books]
        for b in batches:
            parts, w = _matrix(b, "part"), b.column(b.schema.get_field_index("weight")).to_numpy()
            for p, rows in _by_position(b):
                code, _ = nearest(parts[rows], books[p])
                np.add.at(weight[p], code, w[rows])
                np.add.at(total[p], code, parts[rows] * w[rows, None])
        for p in range(len(books)):
            used = np.flatnonzero(weight[p])
            if len(used):
                sums = pa.ListArray.from_arrays(pa.array(np.arange(len(used) + 1, dtype=np.int32) * total[p].shape[1]), pa.array(total[p][used].ravel()))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(used), p, np.int32)), pa.array(used.astype(np.int32)), pa.array(weight[p][used]), sums], ["position", "entry", "weight", "total"])

    return run


def _assigned(books: list[np.ndarray]):
    """(position, part, code, error) of a task's distinct parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts = _matrix(b, "part")
            code, error = np.zeros(len(b), np.int32), np.zeros(len(b), np.int64)
            for p, rows in _by_position(b):
                code[rows], error[rows] = nearest(parts[rows], books[p])
            names = ["position", "part"]
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(n)) for n in names), pa.array(code), pa.array(error)], [*names, "code", "error"])

    return run


def compress(vectors: DataFrame, *, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, list[np.ndarray]]:
    """(vec_id, label, codes array<int>, error) of the rows kept, and the codebooks, one of at most entries rows a position.

    vectors has vec_id, embedding and label. A codebook starts as the parts of the vectors with the smallest vec_ids; of
    rows that share one the smaller vector goes first, null ids go last. Null ids and labels and repeated rows are kept;
    null vectors and vectors with null or non-finite components are not. A vector shorter than the longest is taken as if
    zeros followed, and so is a length that parts doesn't divide. Components beyond +-65,536 are taken as these. Without a
    vector the result is empty. Extra columns, whatever their names, play no part.
    """
    kept = vectors.where(_finite("embedding")).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("int").alias("label"), _integers("embedding").alias("v"))
    longest = kept.agg(F.max(F.size("v"))).first()[0] or 0
    width = -(-longest // parts)
    full = F.concat("v", F.array_repeat(F.lit(0), F.lit(width * parts) - F.size("v")))
    # row numbers are those of the written table, so they stay what they are when a task runs again
    own = written(kept.select(F.monotonically_increasing_id().alias("row"), "vec_id", "label", full.alias("v")), "codes-vectors")
    part = F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda p: F.slice("v", p * width + 1, width)) if width else F.array_repeat(F.array().cast("array<int>"), parts)
    split = own.select("row", "vec_id", "label", F.posexplode(part).alias("position", "part"))
    distinct = written(split.groupBy("position", "part").agg(F.count("*").alias("weight")), "codes-parts")
    first = own.select("vec_id", "v").orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).collect()
    if not first:
        return own.select("vec_id", "label", F.array().cast("array<int>").alias("codes"), F.lit(0).cast("long").alias("error")), [np.zeros((0, 0), np.int64)] * parts
    start = np.array([r["v"] for r in first], np.int64).reshape(len(first), parts, width)
    books = [np.ascontiguousarray(start[:, p]) for p in range(parts)]
    for _ in range(rounds):
        sums = arrow_map(distinct, _sums(books), "position int, entry int, weight long, total array<long>")
        added = (F.sum(F.get("total", F.lit(i))).alias(f"s{i}") for i in range(width))
        for r in sums.groupBy("position", "entry").agg(F.sum("weight").alias("weight"), *added).collect():  # a row an entry
            books[r["position"]][r["entry"]] = [r[f"s{i}"] // r["weight"] for i in range(width)]
    coded = arrow_map(distinct, _assigned(books), "position int, part array<int>, code int, error long")
    met = split.join(coded, ["position", "part"])
    codes = F.transform(F.array_sort(F.collect_list(F.struct("position", "code"))), lambda x: x["code"])
    return met.groupBy("row", "vec_id", "label").agg(codes.alias("codes"), F.sum("error").alias("error")).drop("row"), books


def op12(vectors: DataFrame) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) of every row kept; odd rows are treated as by `compress`."""
    coded, books = compress(vectors)
    coded = written(coded, "codes-coded")
    digest = hashlib.sha256(",".join(str(x) for book in books for x in book.ravel().tolist()).encode()).hexdigest()
    by_label = coded.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "_label")
    code = F.lower(F.concat_ws("", F.transform("codes", lambda c: F.lpad(F.hex(c.cast("long")), 2, "0"))))
    return coded.join(by_label, F.col("label").eqNullSafe(F.col("_label"))).select("vec_id", code.alias("code"), "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def _assign_sql(book: str) -> str:
    return f"""
  SELECT position, part, weight, entry, d FROM (
    SELECT p.position, p.part, p.weight, b.entry,
           list_sum(list_transform(list_zip(p.part, b.value), lambda x: (x[1] - x[2]) * (x[1] - x[2]))) AS d,
           row_number() OVER (PARTITION BY p.position, p.part ORDER BY d, b.entry) AS nth
    FROM parts p JOIN {book} b ON b.position = p.position
  ) WHERE nth = 1"""


def _round_sql(n: int) -> str:
    return f"""
near{n} AS MATERIALIZED ({_assign_sql(f"book{n - 1}")}
), sums{n} AS (
  SELECT position, entry, i, CAST((sum(part[i] * weight) - ((sum(part[i] * weight) % sum(weight)) + sum(weight)) % sum(weight)) // sum(weight) AS BIGINT) AS x
  FROM (SELECT *, unnest(range(1, len(part) + 1)) AS i FROM near{n}) GROUP BY position, entry, i
), lists{n} AS (
  SELECT position, entry, list(x ORDER BY i) AS value FROM sums{n} GROUP BY position, entry
), book{n} AS MATERIALIZED (
  SELECT b.position, b.entry, coalesce(l.value, b.value) AS value FROM book{n - 1} b LEFT JOIN lists{n} l ON l.position = b.position AND l.entry = b.entry
)"""


#: op12 in SQL for DuckDB: the same rounds over all pairs of distinct parts and entries.
OP12_SQL = f"""
WITH kept AS MATERIALIZED (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * {SCALE}) AS BIGINT)) AS v,
         row_number() OVER () AS row
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), split AS MATERIALIZED (
  SELECT row, vec_id, label, p AS position, v[p * len(v) // {PARTS} + 1 : (p + 1) * len(v) // {PARTS}] AS part
  FROM kept, range({PARTS}) t(p)
), parts AS MATERIALIZED (
  SELECT position, part, count(*) AS weight FROM split GROUP BY position, part
), ranked AS (
  SELECT row, row_number() OVER (ORDER BY vec_id NULLS LAST, v) - 1 AS entry FROM kept
), book0 AS MATERIALIZED (
  SELECT s.position, l.entry, s.part AS value FROM ranked l JOIN split s ON s.row = l.row WHERE l.entry < {ENTRIES}
), {", ".join(_round_sql(n) for n in range(1, ROUNDS + 1))}, coded AS MATERIALIZED ({_assign_sql(f"book{ROUNDS}")}
), digest AS (
  SELECT sha256(string_agg(array_to_string(value, ','), ',' ORDER BY position, entry)) AS codebooks_sha256 FROM book{ROUNDS}
), vectors AS (
  SELECT s.row, s.vec_id, s.label, string_agg(printf('%02x', c.entry), '' ORDER BY s.position) AS code, CAST(sum(c.d) AS BIGINT) AS error
  FROM split s JOIN coded c ON c.position = s.position AND c.part = s.part GROUP BY ALL
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM vectors, digest
"""
