"""Mixing sources to target weights by systematic sampling, with DataFrame functions only.

A source's documents are put in order; each is expected target / size of the source times. The prefix sums of the
expected copies, shifted by one offset for the source, cross an integer boundary for every copy taken. The order
goes by size class first, so the copies spread evenly over short and long documents and the words taken come near
the target, and by a hash of doc_id within a class.

No source is put in order by one task. A source is cut in runs of that order - a size class and the leading hex
digits of the hash, and for rows that share a hash, having no doc_id or one that very many rows repeat, the size and leading
digits of a hash of the text - and a document's rank is the number of documents in earlier classes and runs plus its rank
in its own run. Which doc_ids are repeated very often is asked of a frequent-item sketch; the order doesn't depend on it.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import n_words, written

#: Leading bits of a size that name its class, and hex digits of the hash that name a run within a class.
BITS, DIGITS = 5, 2
#: A doc_id is repeated very often if it is one in OFTEN rows; the most of them to look for, and what the sketch tracks for it.
OFTEN, MOST, TRACKED = 1000, 64, 16_384


def _hex(digit: Column) -> Column:
    return F.instr(F.lit("0123456789abcdef"), digit) - 1


def targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """(source, source_size, target) from (source, size).

    Sources by code point, null last, take the weights in turn. Targets share the sum of all sizes by weight; one
    above most times its source's size stops there, and the rest is shared again until none is above.
    """
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1  # a row a source
    weight = F.element_at(F.array(*map(F.lit, weights)), (rank % len(weights) + 1).cast("int"))
    sources = written(sources.select("source", "source_size", weight.cast("long").alias("weight"), (F.col("source_size") * most).alias("cap")), "mix-sources")
    level = capped = 0.0
    while True:
        above = F.col("weight") * F.lit(level) > F.col("cap")
        row = sources.agg(F.sum("source_size").alias("total"), F.count_if(above).alias("n"), F.sum(F.when(above, F.col("cap")).otherwise(0)).alias("cap"), F.sum(F.when(~above, F.col("weight")).otherwise(0)).alias("w")).first()
        if not row["w"] or (level and row["n"] == capped):
            break
        level, capped = (row["total"] - row["cap"]) / row["w"], row["n"]
        if not level:
            break
    return sources.select("source", "source_size", F.least(F.col("weight") * F.lit(float(level)), F.col("cap").cast("double")).alias("target"))


def _mark() -> Column:
    """Tells apart the texts of rows that share a doc_id, so that ties have one order."""
    return F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")))


def _hash() -> Column:
    return F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))


def repeated(sizes: DataFrame) -> list[str]:
    """Hashes of the doc_ids that very many rows share, in order, and that of none; no more than MOST + 1."""
    top = F.expr(f"approx_top_k(coalesce(CAST(doc_id AS STRING), ''), {MOST}, {TRACKED})")
    often = sizes.agg(F.count("*").alias("rows"), top.alias("top")).select("rows", F.explode("top").alias("t")).where(F.col("t.count") * OFTEN >= F.col("rows"))
    found = often.select(F.md5(F.col("t.item")).alias("h")).collect()
    return sorted({hashlib.md5(b"").hexdigest(), *(r["h"] for r in found)})


def with_copies(docs: DataFrame, sizes: DataFrame, *, seed: int = 0, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """docs (with columns size and mark) and how often each row is taken: source_size, target, copies.

    sizes: doc_id, source, size and mark of the same rows, a written table.
    """

    hot = F.array(*map(F.lit, repeated(sizes)))

    def ordered(df: DataFrame) -> DataFrame:
        bits = F.bin("size")
        hashed = df.withColumns({"_class": (F.length(bits) * 2**BITS + F.conv(F.substring(bits, 1, BITS), 2, 10).cast("int")).cast("int"), "_hash": _hash()})
        lower = F.lpad(F.size(F.filter(hot, lambda h: h < F.col("_hash"))).cast("string"), 3, "0")
        spread = F.concat(F.lit("1"), F.lpad(F.col("size").cast("string"), 19, "0"), F.substring("mark", 1, DIGITS))
        own = F.concat(lower, F.when(F.array_contains(hot, F.col("_hash")), spread).otherwise("0"))  # where repeated doc_ids stand
        return hashed.withColumn("_run", F.concat(F.substring("_hash", 1, DIGITS), own))

    goal = targets(sizes, weights, most).withColumnRenamed("source", "_source")
    runs = ordered(sizes).groupBy(F.col("source").alias("_of"), F.col("_class").alias("_c"), F.col("_run").alias("_r")).count()
    earlier = lambda *by: Window.partitionBy(*by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, -1)
    classes = runs.groupBy(F.col("_of").alias("_of2"), F.col("_c").alias("_c2")).agg(F.sum("count").alias("n"))
    classes = classes.select("_of2", "_c2", F.coalesce(F.sum("n").over(earlier("_of2", "_c2")), F.lit(0)).alias("_lower"))  # a row a class
    runs = runs.select("_of", "_c", "_r", F.coalesce(F.sum("count").over(earlier("_of", "_c", "_r")), F.lit(0)).alias("_within"))  # a row a run
    runs = runs.join(classes, F.col("_of").eqNullSafe(F.col("_of2")) & (F.col("_c") == F.col("_c2"))).select("_of", "_c", "_r", (F.col("_lower") + F.col("_within")).alias("_before"))
    runs = runs.join(goal, F.col("_of").eqNullSafe(F.col("_source"))).drop("_source")
    mark = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("source"), F.lit("")), F.when(F.col("source").isNull(), "\0").otherwise("")))
    offset = sum((_hex(F.substring(mark, k + 1, 1)) * 16 ** (3 - k) for k in range(4)), F.lit(0)) / F.lit(65536.0)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rank = F.col("_before") + F.row_number().over(Window.partitionBy("source", "_class", "_run").orderBy("_hash", "doc_id", "size", "mark"))
    joined = ordered(docs).join(runs, F.col("source").eqNullSafe(F.col("_of")) & (F.col("_class") == F.col("_c")) & (F.col("_run") == F.col("_r")))
    placed = joined.withColumns({"_rank": rank, "_rate": rate, "_offset": offset})
    copies = F.floor(F.col("_offset") + F.col("_rank") * F.col("_rate")) - F.floor(F.col("_offset") + (F.col("_rank") - 1) * F.col("_rate"))
    return placed.withColumn("copies", copies.cast("long")).drop("_class", "_hash", "_run", "_of", "_c", "_r", "_before", "_rank", "_rate", "_offset")


def _sizes(docs: DataFrame) -> DataFrame:
    return written(docs.select("doc_id", F.col("source").cast("string").alias("source"), n_words().alias("size"), _mark().alias("mark")), "mix-sizes")


def op6(docs: DataFrame, *, seed: int = 0) -> DataFrame:
    """(doc_id, size, source_size, target, taken) of every row of docs; needs doc_id, source and text.

    Words of a null text: none. A null source is a source of its own, the last. Rows without words are taken by the
    same rule and add none. Rows that repeat each other rank one after the other; rows that share a doc_id and a size
    rank by a hash of their texts. Reruns with a seed agree. Texts of any length are counted whole. Extra columns,
    whatever their names, play no part. An empty table gives an empty result.
    """
    sizes = _sizes(docs)
    return with_copies(sizes, sizes, seed=seed).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def mix(docs: DataFrame, *, seed: int = 0, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """The mix itself: every row of docs as often as it is taken, columns as they are, whatever their names.

    Null texts, null and repeated doc_ids, ties and reruns are as for `op6`; an empty table stays empty.
    """
    own = docs.withColumn("_row", F.struct(*docs.columns)).select("_row", "doc_id", F.col("source").cast("string").alias("source"), n_words().alias("size"), _mark().alias("mark"))
    taken = with_copies(own, _sizes(docs), seed=seed, weights=weights, most=most).where("copies > 0")
    return taken.select(F.explode(F.array_repeat("_row", F.col("copies").cast("int"))).alias("_row")).select("_row.*")


#: op6 in SQL for DuckDB, with the same order, offsets and arithmetic.
OP6_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, 3 * CAST(sum(size) AS BIGINT) AS cap,
         1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS weight
  FROM d GROUP BY source
), w AS (
  SELECT *, CAST(sum(source_size) OVER () AS BIGINT) AS total, row_number() OVER (ORDER BY CAST(cap AS DOUBLE) / weight, source NULLS LAST) AS k,
         CAST(sum(weight) OVER () - coalesce(sum(weight) OVER earlier, 0) AS BIGINT) AS w_left,
         CAST(coalesce(sum(cap) OVER earlier, 0) AS BIGINT) AS cap_before
  FROM s WINDOW earlier AS (ORDER BY CAST(cap AS DOUBLE) / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), l AS (
  SELECT coalesce(arg_min(CAST(total - cap_before AS DOUBLE) / w_left, k) FILTER (CAST(total - cap_before AS DOUBLE) / w_left * weight <= cap), 0) AS level FROM w
), t AS (
  SELECT source, source_size, least(weight * level, CAST(cap AS DOUBLE)) AS target FROM s, l
), o AS (
  SELECT d.doc_id, d.size, t.source_size, t.target,
         CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
         md5('0:' || coalesce(d.source, '') || CASE WHEN d.source IS NULL THEN chr(0) ELSE '' END) AS mark,
         row_number() OVER (PARTITION BY d.source ORDER BY length(bin(d.size)), substr(bin(d.size), 1, 5), md5(coalesce(CAST(d.doc_id AS VARCHAR), '')), d.doc_id, d.size) AS rank
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), u AS (
  SELECT *, (strpos('0123456789abcdef', substr(mark, 1, 1)) - 1) * 4096 + (strpos('0123456789abcdef', substr(mark, 2, 1)) - 1) * 256
          + (strpos('0123456789abcdef', substr(mark, 3, 1)) - 1) * 16 + (strpos('0123456789abcdef', substr(mark, 4, 1)) - 1) AS ticks FROM o
)
SELECT doc_id, size, source_size, target,
       CAST(floor(ticks / 65536.0 + rank * rate) - floor(ticks / 65536.0 + (rank - 1) * rate) AS BIGINT) * size AS taken
FROM u
"""
