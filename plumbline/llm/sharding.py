"""Minimax contiguous partition into shards, with DataFrame functions only.

Rows with equal texts are an atomic group. Groups stand in the order of a hash of the text. The smallest capacity at
which a greedy fill needs no more shards than there are is found by binary search, and the order is cut there.

The driver never sees all groups. It sees sums over ranges of the hash (a bounded number of them); a range is
looked into only if a cut can fall inside it for some capacity that is still possible, until every such range is
one group. Shards are then ranges of the hash, so a row's shard is an expression of its text and no join.

A group larger than an even share of what is left has a shard of its own: no partition can do better.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import written

#: Bits of the hash that name a range at first, and more bits with each closer look.
COARSE, FINER = 12, 8
#: Fully equal rows that are numbered together.
TOGETHER = 1 << 16


@dataclass
class Cuts:
    """Hashes of the groups that have a shard of their own, then the last hash of each further shard but the final one."""

    alone: list[int]
    upper: list[int]
    capacity: int

    def shard(self, h: Column) -> Column:
        value = F.lit(len(self.alone))
        for u in self.upper:
            value = value + F.when(h > u, 1).otherwise(0)
        for n, a in enumerate(self.alone):
            value = F.when(h == a, n).otherwise(value)
        return value.cast("int")


def greedy(ends: np.ndarray, capacity: int, shards: int) -> np.ndarray | None:
    """Where each shard ends (an index into ends, the prefix sums) when filled up to capacity; None if that takes too many shards."""
    cuts, at, full = [], -1, 0
    while at < len(ends) - 1:
        if len(cuts) == shards:
            return None
        to = int(np.searchsorted(ends, full + capacity, "right")) - 1
        if to == at:
            return None
        cuts.append(to)
        at, full = to, int(ends[to])
    return np.array(cuts, np.int64)


def smallest(ends: np.ndarray, shards: int, low: int) -> int:
    """The smallest capacity from low on that is feasible."""
    high = max(low, int(ends[-1]) if len(ends) else 0)
    while low < high:
        middle = (low + high) // 2
        if greedy(ends, middle, shards) is None:
            low = middle + 1
        else:
            high = middle
    return low


def plan(groups: DataFrame, shards: int) -> Cuts:
    """groups: (h long, bytes long), one row a group, a written table."""
    total = groups.agg(F.sum("bytes")).first()[0] or 0
    alone: list[int] = []
    left, free = total, shards
    for row in groups.orderBy(F.desc("bytes"), "h").limit(shards).collect():
        if free > 1 and row["bytes"] * free > left:
            alone.append(row["h"])
            left, free = left - row["bytes"], free - 1
        else:
            break
    rest = groups.where(~F.col("h").isin(alone)) if alone else groups

    def ranges(bits: int, df: DataFrame) -> list[tuple[int, int, int]]:
        """(last hash, bytes, groups) of the ranges that bits name, in order."""
        found = df.groupBy(F.shiftright("h", 64 - bits).alias("r")).agg(F.sum("bytes").alias("b"), F.count("*").alias("n")).collect()
        return [(((r["r"] + 1) << (64 - bits)) - 1, r["b"], r["n"]) for r in sorted(found, key=lambda r: r["r"])]

    bits = COARSE
    nodes = ranges(bits, rest)
    while True:
        sizes = np.array([b for _, b, _ in nodes], np.int64)
        ends = np.cumsum(sizes)
        single = np.array([n == 1 for *_, n in nodes], bool)
        low = max(-(-left // free), int(sizes[single].max(initial=0)))
        high = smallest(ends, free, max(low, int(sizes.max(initial=0))))
        if bits >= 64 or single.all():
            break
        # A cut falls between where filling whole ranges up to low ends and where filling without gaps up to high ends.
        begins, first, last = ends - sizes, 0, 0
        near = np.zeros(len(nodes), bool)
        for k in range(1, free):
            to = int(np.searchsorted(ends, first + low, "right"))
            first = int(ends[to - 1]) if to and int(ends[to - 1]) > first else first
            last = k * high
            near |= (ends > first) & (begins < last)
        look = near & ~single
        if not look.any():
            break
        finer = min(64, bits + FINER)
        inside = [nodes[i][0] >> (64 - bits) for i in np.flatnonzero(look)]
        fresh = ranges(finer, rest.where(F.shiftright("h", 64 - bits).isin(inside)))
        nodes = sorted([x for x, l in zip(nodes, look) if not l] + fresh)
        bits = finer
    cuts = greedy(ends, high, free) if len(nodes) else np.zeros(0, np.int64)
    return Cuts(alone, [nodes[i][0] for i in cuts[:-1]], high)


def placed(rows: DataFrame, shard: Column, shards: int) -> DataFrame:
    """Each row as often as its column n says, with shard and slot, slots gapless from 0 in each shard; rows: a written table of
    different rows (doc_id, size, text_crc32, h).

    A shard is not numbered by one task: its rows are dealt by a hash of doc_id and text, numbered there, and shifted by
    the number of rows dealt before. Fully equal rows stand as counts, which are cut into pieces that are dealt apart, and
    are written out only when they have their slots.
    """
    dealt = max(16, (rows.agg(F.sum("n")).first()[0] or 0) // (250_000 * shards) + 1)
    pieces = rows.withColumn("_from", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(TOGETHER).cast("long"))))
    pieces = pieces.withColumns({"n": F.least(F.col("n") - F.col("_from"), F.lit(TOGETHER)), "shard": shard, "_deal": F.pmod(F.xxhash64("doc_id", "size", "h", "_from"), F.lit(dealt)).cast("int")})
    before = lambda own: F.coalesce(F.sum("n").over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shifts = pieces.groupBy("shard", "_deal").agg(F.sum("n").alias("n")).select(F.col("shard").alias("_s"), F.col("_deal").alias("_d"), before(Window.partitionBy("shard").orderBy("_deal")).alias("_before"))
    joined = pieces.join(shifts, (F.col("shard") == F.col("_s")) & (F.col("_deal") == F.col("_d")))
    first = joined.withColumn("_first", F.col("_before") + before(Window.partitionBy("shard", "_deal").orderBy("doc_id", "h", "_from")))
    return first.withColumn("slot", F.explode(F.sequence("_first", F.col("_first") + F.col("n") - 1)))


def shard(docs: DataFrame, shards: int = 16) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) of every row; law `bytes`: the largest shard is as small as whole groups allow.

    size is the text's UTF-8 bytes plus 1. A null text has no bytes and checksum 0, and all null texts are a group.
    Rows without a doc_id and repeated rows are placed like any other. A very long text is a large group, and has a
    shard of its own if it is larger than an even share. Extra columns, whatever their names, play no part. An empty
    table gives an empty result.
    """
    text = F.col("text").cast("string")
    rows = docs.select("doc_id", (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"), F.coalesce(F.crc32(text.cast("binary")), F.lit(0)).cast("long").alias("text_crc32"), F.xxhash64(text).alias("h"))
    rows = written(rows.groupBy("doc_id", "size", "text_crc32", "h").agg(F.count("*").alias("n")), "shard-rows")
    groups = written(rows.groupBy("h").agg(F.sum(F.col("size") * F.col("n")).alias("bytes")), "shard-groups")
    cuts = plan(groups, shards)
    return placed(rows, cuts.shard(F.col("h")), shards).select("doc_id", "size", "text_crc32", "shard", "slot")


def op9(docs: DataFrame) -> DataFrame:
    """Rows of op9_minimax_shards."""
    rows = shard(docs, 16)
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
