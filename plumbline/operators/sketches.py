"""Statistics of large views in bounded state: heavy values in two passes, and profiles under a deadline.

Sketches are Spark's own mergeable aggregates (frequent items, HyperLogLog, theta), so they combine before any shuffle and
over parts of a view. A profile under a deadline sketches a view a group of files at a time and keeps each group, then
counts exactly in the time that is left; if that is too short, what the groups say stands as an approximation.
"""

from __future__ import annotations

import math
import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators import profile
from plumbline.sources.guard import Source
from plumbline.sources.state import Store

#: Relative standard error of a distinct count: 1.04 / sqrt(2 ** LG_K).
LG_K = 12
#: Groups of files that a profile under a deadline keeps one by one.
GROUPS = 16
COLUMN = "column_name string, null_count long, min_value string, max_value string, min_length int, max_length int, length_sum long, hll binary"
SKETCHES = f"rows long, files long, columns array<struct<{COLUMN.replace(' ', ':').replace(',:', ',')}>>"


def heavy_values(df: DataFrame, columns: list[str], share: float = profile.RARE_RATE, also: list[tuple[str, str | None]] = ()) -> DataFrame:
    """(column_name, value, frequency, rows) of every value, null too, that share of the rows or more have; exact.

    also: (column, value) that are counted whatever their share is.

    The first pass keeps at most 8 / share counters a column and task, which hold every value that more than 0.66 share of
    the rows have; the second counts these candidates only, at most 2 / share a column. Values of unique columns are never
    shuffled.
    """
    most, tracked = math.ceil(2 / share), math.ceil(8 / share)
    sketch = df.agg(F.count("*").alias("rows"), *(F.expr(f"approx_top_k(CAST(`{c}` AS STRING), {most}, {tracked})").alias(f"t{i}") for i, c in enumerate(columns))).first()
    found = [(c, x["item"]) for i, c in enumerate(columns) for x in sketch[f"t{i}"]]
    spark, named = df.sparkSession, list(dict.fromkeys(also))
    asked = F.broadcast(spark.createDataFrame(list(dict.fromkeys([*found, *named])), "_column string, _value string"))
    pairs = df.select(F.inline(F.array(*(F.struct(F.lit(c).alias("column_name"), profile.text(f"`{c}`").alias("value")) for c in columns))))
    kept = pairs.join(asked, (F.col("column_name") == F.col("_column")) & F.col("value").eqNullSafe(F.col("_value")), "left_semi")
    counted = kept.groupBy("column_name", "value").agg(F.count("*").alias("frequency")).withColumn("rows", F.lit(sketch["rows"]))
    by_name = F.broadcast(spark.createDataFrame(named, "_column string, _value string").withColumn("_named", F.lit(True)))
    if named:
        counted = counted.join(by_name, (F.col("column_name") == F.col("_column")) & F.col("value").eqNullSafe(F.col("_value")), "left").drop("_column", "_value")
    enough = F.col("frequency") >= F.lit(share) * F.col("rows")
    return counted.where(enough | F.coalesce("_named", F.lit(False))).drop("_named") if named else counted.where(enough)


def top_values(df: DataFrame, columns: list[str], k: int = profile.TOP_K, share: float = profile.RARE_RATE) -> DataFrame:
    """profile.top_values over all values of the columns; counts all values only of columns whose k-th isn't heavy.

    A column is settled by its heavy values if there are k of them, or if they are all it has.
    """
    heavy = heavy_values(df, columns, share)
    by = {c: (0, 0, 0) for c in columns} | {r["column_name"]: (r["n"], r["held"], r["rows"]) for r in heavy.groupBy("column_name").agg(F.count("*").alias("n"), F.sum("frequency").alias("held"), F.first("rows").alias("rows")).collect()}  # a row a column
    open_ = [c for c, (n, held, rows) in by.items() if n < k and held < rows or not n]
    out = profile.top_values(heavy.drop("rows").where(~F.col("column_name").isin(open_)), k)
    return out.unionByName(profile.top_values(profile.frequencies(df, open_), k)) if open_ else out


def key_sentinel(df: DataFrame, columns: list[str], share: float = profile.SENTINEL_SHARE) -> DataFrame:
    """profile.key_sentinel without counting the values that can't be one."""
    return profile.top_values(heavy_values(df, columns, share), 1).select("column_name", "value", "frequency", "rows")


def _sketch(df: DataFrame, files: int) -> DataFrame:
    """One row of SKETCHES; one pass, and nothing but sketches is shuffled."""
    fields = [f for f in df.schema.fields if f.name != "_metadata"]
    parts = []
    for i, f in enumerate(fields):
        c, kind = F.col(f"`{f.name}`"), profile.family(f.dataType)
        shown = kind != "other" and not (profile.is_identifier(f.name) and not profile.is_key(f.name, f.dataType))
        length = F.length(F.rtrim(c)) if kind == "string" else F.lit(None).cast("int")
        hll = F.hll_sketch_agg(c.cast("string"), F.lit(LG_K)) if kind != "other" else F.lit(None).cast("binary")
        end = lambda g: (g(c) if shown else F.lit(None)).cast("string")  # noqa: B023, E731
        parts.append(F.struct(F.lit(f.name).alias("column_name"), F.count_if(c.isNull()).alias("null_count"), end(F.min).alias("min_value"), end(F.max).alias("max_value"), F.min(length).alias("min_length"), F.max(length).alias("max_length"), F.sum(length.cast("long")).alias("length_sum"), hll.alias("hll")).alias(f"c{i}"))
    return df.agg(F.count("*").alias("rows"), *parts).select("rows", F.lit(files).cast("long").alias("files"), F.array(*(f"c{i}" for i in range(len(fields)))).alias("columns"))


def _file_groups(df: DataFrame, groups: int) -> list[tuple[DataFrame, int]]:
    """Parts of a view by the files they are read from, and how many files each has; one part where the view doesn't say.

    The last part is all that isn't in the others, so nothing is lost if a name is spelt otherwise.
    """
    try:
        path = df.select("*", F.col("_metadata.file_path").alias("_path"))
        files = sorted({f.replace("file:///", "file:/") for f in df.inputFiles()})
    except Exception:  # noqa: BLE001  it isn't read from files directly
        return [(df, 1)]
    if len(files) < 2:
        return [(df, 1)]
    size = -(-len(files) // groups)
    cuts = [files[i : i + size] for i in range(0, len(files), size)]
    out = [(path.where(F.col("_path").isin(c)).drop("_path"), len(c)) for c in cuts[:-1]]
    return [*out, (path.where(~F.col("_path").isin([f for c in cuts[:-1] for f in c])).drop("_path"), len(cuts[-1]))]


def merged(parts: DataFrame, df: DataFrame, files: int) -> DataFrame:
    """The columns of profile.profile from kept SKETCHES of a view, with the share of its files that they cover.

    Minimum and maximum are those of the covered rows, by the columns' types; a distinct count is an estimate.
    """
    kinds = {f.name: f.dataType for f in df.schema.fields}
    total = parts.agg(F.sum("rows").alias("rows"), (F.sum("files") / F.lit(files)).alias("coverage"))
    ends = lambda g, n: F.coalesce(*(F.when(F.col("column_name") == c, g(F.when(F.col("column_name") == c, F.col(n).cast(t))).cast("string")) for c, t in kinds.items() if profile.family(t) != "other"), F.lit(None).cast("string"))
    each = parts.select(F.inline("columns")).groupBy("column_name").agg(
        F.sum("null_count").alias("null_count"),
        ends(F.min, "min_value").alias("min_value"),
        ends(F.max, "max_value").alias("max_value"),
        F.min("min_length").alias("min_length"),
        F.max("max_length").alias("max_length"),
        F.sum("length_sum").alias("length_sum"),
        F.hll_sketch_estimate(F.hll_union_agg("hll")).alias("distinct_count"),
    )
    names = df.sparkSession.createDataFrame([(i, f.name, f.dataType.simpleString(), profile.family(f.dataType), profile.is_key(f.name, f.dataType)) for i, f in enumerate(df.schema.fields, 1)], "position int, column_name string, data_type string, family string, key_like boolean")
    out = names.join(each, "column_name").crossJoin(F.broadcast(total))
    out = out.withColumn("avg_length", F.round(F.col("length_sum") / (F.col("rows") - F.col("null_count")), 4)).drop("length_sum")
    out = out.withColumn("distinct_count", F.when(F.col("family") != "other", F.least("distinct_count", F.col("rows") - F.col("null_count"))))
    return profile.classified(out.withColumn("null_rate", F.when(F.col("rows") > 0, F.round(F.col("null_count") / F.col("rows"), 6))))


def profile_within(source: Source, view: str, seconds: float | None, store: Store, run_id: str, *, groups: int = GROUPS, exact: bool = True) -> tuple[DataFrame, str]:
    """profile.profile of a view, with the share of its files that it covers, and exact, approximate or timeout.

    Without a deadline the profile is exact. With one, the view is sketched first, a group of files at a time; each group
    is kept under run_id, so a call that is repeated goes on behind the last one. Then all is counted exactly, if the time
    allows. approximate: as far as the groups got. timeout: not one group was done, nothing but names and types is known,
    and classes fall back to the safest. exact=False leaves the exact count out.
    """
    df, end = source.views[view], None if seconds is None else time.monotonic() + seconds
    left = lambda: None if end is None else end - time.monotonic()
    write = lambda name, out: (lambda: store.append("profiles", out, name) or True)
    cuts = _file_groups(df, groups)
    if not exact or seconds is not None:
        for n, (part, files) in enumerate(cuts):
            name = f"{run_id}--{view}--{n}"
            if not store.has("profiles", name) and not ((left() is None or left() > 0) and source.within(left(), write(name, _sketch(part, files)))):
                break
    if exact and (left() is None or left() > 0):
        out, name = profile.profile(df).withColumn("coverage", F.lit(1.0)), f"{run_id}--{view}--exact"
        if store.has("profiles", name) or source.within(left(), write(name, out)):
            return store.part("profiles", out.schema, name), "exact"
    kept = [store.part("profiles", SKETCHES, p) for p in store.parts("profiles", f"{run_id}--{view}--") if not p.endswith("--exact")]
    if kept:
        parts = kept[0]
        for k in kept[1:]:
            parts = parts.unionByName(k)
        return merged(parts, df, sum(n for _, n in cuts)), "approximate"
    nothing = ", ".join(f"CAST(NULL AS {t}) AS {c}" for c, t in (("null_count", "LONG"), ("min_value", "STRING"), ("max_value", "STRING"), ("min_length", "INT"), ("max_length", "INT"), ("rows", "LONG"), ("avg_length", "DOUBLE"), ("distinct_count", "LONG"), ("null_rate", "DOUBLE")))
    names = [(i, f.name, f.dataType.simpleString(), profile.family(f.dataType), profile.is_key(f.name, f.dataType)) for i, f in enumerate(df.schema.fields, 1)]
    known = source.spark.createDataFrame(names, "position int, column_name string, data_type string, family string, key_like boolean").selectExpr("*", *nothing.split(", "))
    return profile.classified(known).withColumn("coverage", F.lit(0.0)), "timeout"


def theta_containments(views: dict[str, DataFrame], columns: list[tuple[str, str]], lg_k: int = 14) -> DataFrame:
    """(ka, kb, distinct_a, distinct_b, common, bound) of all pairs of columns, by number, from one sketch a column.

    Theta sketches sample values by their hashes, all columns the same ones, so two columns' sketches show what they share.
    bound: three standard errors of common. Numbers compare as numbers, as in profile.containments. What is shuffled is a
    sketch a task and column, 8 * 2 ** lg_k bytes each at most.
    """
    out = None
    for v in dict.fromkeys(v for v, _ in columns):
        own = [(n, c) for n, (w, c) in enumerate(columns) if w == v]
        kind = {c: profile.family(views[v].schema[c].dataType) for _, c in own}
        value = lambda c: F.concat(F.lit(f"{kind[c]}:"), (F.col(f"`{c}`").cast("decimal(38,6)") if kind[c] == "numeric" else F.col(f"`{c}`")).cast("string"))  # noqa: B023, E731
        one = views[v].agg(*(F.theta_sketch_agg(value(c), lg_k).alias(f"s{n}") for n, c in own))
        one = one.select(F.inline(F.array(*(F.struct(F.lit(n).alias("k"), F.col(f"s{n}").alias("s")) for n, _ in own))))
        out = one if out is None else out.unionByName(one)
    a, b = out.select(F.col("k").alias("ka"), F.col("s").alias("x")), out.select(F.col("k").alias("kb"), F.col("s").alias("y"))
    both = a.join(b, F.col("ka") < F.col("kb"))  # a row a column on either side
    est = F.theta_sketch_estimate
    both = both.select("ka", "kb", est("x").alias("distinct_a"), est("y").alias("distinct_b"), est(F.theta_intersection("x", "y")).alias("common"))
    # a sketch of more than 2^lg_k values holds about so many of them, and of what is shared the same part
    kept = F.least(F.lit(1.0), F.lit(float(1 << lg_k)) / F.greatest("distinct_a", "distinct_b", F.lit(1)))
    return both.withColumn("bound", F.ceil(3 * F.sqrt(F.greatest("common", F.lit(1)) * (1 - kept) / kept)))


PAIR = "view_a string, column_a string, view_b string, column_b string"
RELATIONS = f"{PAIR}, distinct_a long, distinct_b long, common long, orphans_a long, orphans_b long, containment_a double, containment_b double, bound long, status string"
#: A containment below this doesn't make a relationship, so a pair that surely stays below isn't counted exactly.
CONTAINED = 0.5
PAIRS_AT_ONCE = 50


def containments_within(source: Source, pairs: list[tuple[str, str, str, str]], seconds: float | None, store: Store, run_id: str, *, contained: float = CONTAINED, lg_k: int = 14, at_once: int = PAIRS_AT_ONCE) -> DataFrame:
    """RELATIONS of all pairs, as exact as the time allows; what was evaluated under run_id before is not evaluated again.

    First all columns are sketched, in one pass a view. Pairs whose containment may reach `contained` one way are then
    counted exactly, so many at once, the most promising first, and each lot is kept. status: exact; estimated: common and
    what follows from it may be off by bound; skipped_cost: there was no time for an estimate, and nothing is known.
    """
    spark, end = source.spark, None if seconds is None else time.monotonic() + seconds
    left = lambda: None if end is None else end - time.monotonic()
    in_time = lambda: left() is None or left() > 0
    key = PAIR.replace(" string", "").split(", ")
    asked = spark.createDataFrame(list(dict.fromkeys(pairs)), PAIR)
    none = spark.createDataFrame([], RELATIONS)

    def kept() -> DataFrame:
        out = none
        for p in store.parts("relationships", f"{run_id}--exact"):
            out = out.unionByName(store.part("relationships", RELATIONS, p))
        return out

    def keep(name: str, rows: DataFrame) -> bool:
        return bool(source.within(left(), lambda: store.append("relationships", rows.select(*none.columns), name) or True))

    estimate = f"{run_id}--estimate"
    todo = [tuple(r) for r in asked.join(kept(), key, "left_anti").collect()]  # a row a pair, as given
    if todo and not store.has("relationships", estimate) and in_time():
        columns = list(dict.fromkeys(c for a, x, b, y in pairs for c in ((a, x), (b, y))))
        at = {c: n for n, c in enumerate(columns)}
        numbered = spark.createDataFrame([(*p, min(at[p[:2]], at[p[2:]]), max(at[p[:2]], at[p[2:]]), at[p[:2]] > at[p[2:]]) for p in todo], f"{PAIR}, ka int, kb int, turned boolean")
        met = numbered.join(theta_containments(source.views, columns, lg_k), ["ka", "kb"])
        one = lambda x, y: F.when(F.col("turned"), F.col(y)).otherwise(F.col(x))
        met = met.select(*key, one("distinct_a", "distinct_b").alias("distinct_a"), one("distinct_b", "distinct_a").alias("distinct_b"), "common", "bound")
        rate = lambda d: F.when(F.col(d) > 0, F.round(F.col("common") / F.col(d), 6))
        met = met.withColumns({"orphans_a": F.col("distinct_a") - F.col("common"), "orphans_b": F.col("distinct_b") - F.col("common"), "containment_a": rate("distinct_a"), "containment_b": rate("distinct_b"), "status": F.when(F.col("bound") == 0, "exact").otherwise("estimated")})
        keep(estimate, met)
    guess = store.part("relationships", RELATIONS, estimate) if store.has("relationships", estimate) else none
    may = lambda d: F.col("common") + F.col("bound") >= F.lit(contained) * (F.col(d) - F.col("bound"))
    promising = guess.where("status = 'estimated'").where(may("distinct_a") | may("distinct_b")).join(kept(), key, "left_anti")
    order = [tuple(r)[:4] for r in promising.orderBy(F.desc(F.greatest("containment_a", "containment_b")), *key).collect()]
    done = len(store.parts("relationships", f"{run_id}--exact"))
    for i in range(0, len(order), at_once):
        if not in_time():
            break
        rows = profile.containments(source.views, order[i : i + at_once]).withColumns({"bound": F.lit(0).cast("long"), "status": F.lit("exact")})
        if not keep(f"{run_id}--exact-{done + i // at_once:06d}", rows):
            break
    exact = kept()
    rest = guess.join(exact, key, "left_anti")
    skipped = asked.join(exact, key, "left_anti").join(rest, key, "left_anti").withColumn("status", F.lit("skipped_cost"))
    return asked.join(exact.unionByName(rest).unionByName(skipped, allowMissingColumns=True), key)
