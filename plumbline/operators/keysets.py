"""Key sets by ranges: which parts of a view changed since the last run, so that only these are read.

A view's keys are dealt into ranges of a numeric key - which the scan can prune by - or else into buckets of a hash. Each
range has a count, a xor and a sum of its distinct keys' hashes, kept a run. Two runs' sums differ where keys came or went.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.operators import profile

SUMMARY = "bucket long, n long, xor long, total string"
RANGES = 4096
#: Ranges that a scan's condition names one by one; beyond, the nearest are joined, which reads more and loses nothing.
CONDITIONS = 200


@dataclass(frozen=True)
class Layout:
    """Ranges of `width` keys from `low` on, of one numeric key; without a width, so many buckets of a hash of all keys."""

    key: tuple[str, ...]
    low: int = 0
    width: int | None = None
    buckets: int = RANGES

    def bucket(self, columns: list[Column] | None = None) -> Column:
        """The bucket of a row of the view, or of other columns with the key's values."""
        columns = columns or [F.col(f"`{c}`") for c in self.key]
        if self.width:
            return F.floor((columns[0].cast("decimal(38,0)") - self.low) / self.width).cast("long")
        return F.pmod(F.xxhash64(*(c.cast("string") for c in columns)), F.lit(self.buckets)).cast("long")

    def condition(self, buckets: list[int]) -> str:
        """SQL that keeps the rows of some buckets; ranges of a numeric key reach the scan as comparisons."""
        if not self.width:
            names = ", ".join(f"CAST(`{c}` AS STRING)" for c in self.key)
            return f"pmod(xxhash64({names}), {self.buckets}) IN ({', '.join(map(str, sorted(buckets)))})"
        runs: list[list[int]] = []
        for b in sorted(buckets):
            if runs and b == runs[-1][1]:
                runs[-1][1] = b + 1
            else:
                runs.append([b, b + 1])
        if len(runs) > CONDITIONS:
            gaps = sorted(range(1, len(runs)), key=lambda i: runs[i][0] - runs[i - 1][1], reverse=True)[: CONDITIONS - 1]
            cuts = [0, *sorted(gaps), len(runs)]
            runs = [[runs[a][0], runs[b - 1][1]] for a, b in zip(cuts, cuts[1:])]
        at = lambda b: self.low + b * self.width
        return "(" + " OR ".join(f"(`{self.key[0]}` >= {at(a)} AND `{self.key[0]}` < {at(b)})" for a, b in runs) + ")"


def layout(df: DataFrame, key: tuple[str, ...], ranges: int = RANGES) -> Layout:
    """Equal ranges between the ends of one numeric key; else buckets of a hash."""
    kinds = {f.name: profile.family(f.dataType) for f in df.schema.fields}
    if len(key) == 1 and kinds[key[0]] == "numeric":
        ends = df.agg(F.min(key[0]).alias("a"), F.max(key[0]).alias("b")).first()
        if ends["a"] is not None:
            return Layout(key, int(ends["a"]), max(1, -(-(int(ends["b"]) - int(ends["a"]) + 1) // ranges)))
    return Layout(key, buckets=ranges)


def summary(df: DataFrame, where: Layout) -> DataFrame:
    """SUMMARY of a view's distinct keys; only hashes of keys are shuffled. A null key is in no range of a numeric key."""
    h = F.xxhash64(*(F.col(f"`{c}`").cast("string") for c in where.key))
    keys = df.select(where.bucket().alias("bucket"), h.alias("h")).distinct()
    return keys.groupBy("bucket").agg(F.count("*").alias("n"), F.bit_xor("h").alias("xor"), F.sum(F.col("h").cast("decimal(38,0)")).cast("string").alias("total"))


def changed(before: DataFrame, after: DataFrame) -> DataFrame:
    """(bucket, n_before, n_after) of the ranges whose keys aren't the same."""
    a, b = before.alias("a"), after.alias("b")
    same = F.col("a.n").eqNullSafe(F.col("b.n")) & F.col("a.xor").eqNullSafe(F.col("b.xor")) & F.col("a.total").eqNullSafe(F.col("b.total"))
    both = a.join(b, F.col("a.bucket").eqNullSafe(F.col("b.bucket")), "full_outer").where(~same)
    return both.select(F.coalesce("a.bucket", "b.bucket").alias("bucket"), F.coalesce("a.n", F.lit(0)).alias("n_before"), F.coalesce("b.n", F.lit(0)).alias("n_after"))


def vanished(findings: DataFrame, view: DataFrame, where: Layout, buckets: list[int]) -> DataFrame:
    """Of findings (entity_key, ...) of a view, those in some buckets whose entity is gone; reads these buckets only."""
    kinds = {f.name: f.dataType.simpleString() for f in view.schema.fields}
    own = [F.get_json_object("entity_key", f"$.{c}").cast(kinds[c]) for c in where.key]
    asked = findings.where(where.bucket(own).isin(buckets))
    there = view.where(where.condition(buckets)).select(F.to_json(F.struct(*(F.col(f"`{c}`").alias(c) for c in sorted(where.key)))).alias("entity_key")).distinct()
    return asked.join(there, "entity_key", "left_anti")
