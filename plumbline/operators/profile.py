"""Profiling views: column statistics, classes, keys, containment, watermarks, sentinels and archetypes.

Statistics of all columns of a view come from one aggregate pass; frequencies of all columns to be counted from one
more, over (column, value) pairs, so a wide view is not scanned once a column. What is decided per column is decided in
SQL over the (small) profile.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Name patterns, types and thresholds of the classification.
IDENTIFIER_PATTERNS = ("firstname", "lastname", "surname", "fullname", "preferredname", "nhi", "dob", "birth", "address", "phone", "mobile", "email", "note", "comment", "description", "postcode", "ssn", "passport")
VOCABULARY_PATTERNS = ("disease", "condition", "medication", "allergy", "vaccine")
LINKAGE_PATTERNS = ("patientid", "appointmentid", "encounterid", "visitid", "episodeid", "consultid", "consultationid")
AUDIT_PATTERNS = ("insertedat", "updatedat", "createdat", "modifiedat", "createddate", "modifieddate")
WATERMARK_NAMES = ("insertedat", "updatedat")
TEST_FLAGS = ("istestrecord", "isdummy", "isdeleted", "isactive")
TRUE_TOKENS = ("1", "true")
PLACEHOLDER_DATES = ("1900-01-01", "1753-01-01", "1970-01-01", "9999-12-31", "2099-12-31")
TOP_K, CATEGORICAL_CEILING, SENTINEL_SHARE = 20, 200, 0.05
RARE_RATE, RARE_COUNT = 0.001, 50
FREE_TEXT_LENGTH, LARGE_VIEW, SAMPLE_FRACTION = 400, 100_000, 0.10
NAME_UNIQUENESS, REFERENCE_SAMPLES, TRAILING_TAGS = 0.95, 100, 20
MAGIC_RATIO, MAGIC_LEAST = 3.0, 20
KEY_UNIQUENESS, PAIR_CAP = 0.5, 50


def family(kind: T.DataType) -> str:
    """numeric, string, date or other."""
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.DecimalType)):
        return "numeric"
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return "float"
    if isinstance(kind, (T.StringType, T.VarcharType, T.CharType)):
        return "string"
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "date"
    return "other"


def is_key(name: str, kind: T.DataType, suffixes: tuple[str, ...] = ("id", "key")) -> bool:
    """A numeric column that is named like a key."""
    return family(kind) == "numeric" and name.lower().endswith(suffixes)


def is_identifier(name: str) -> bool:
    return any(p in name.lower() for p in IDENTIFIER_PATTERNS)


def is_vocabulary(name: str) -> bool:
    return any(p in name.lower() for p in VOCABULARY_PATTERNS)


def text(c: str) -> Column:
    """A value as the profile shows it."""
    return F.col(c).cast("string")


def sampling(df: DataFrame, rows: int, watermark: str | None = None, bounds: tuple[datetime, datetime] | None = None, *, large: int = LARGE_VIEW, fraction: float = SAMPLE_FRACTION, seed: int = 0) -> tuple[Column | None, str]:
    """Which rows to profile, as a deterministic predicate, and how it was chosen.

    All of a view of `large` rows or fewer; else every k-th value of a numeric key; else the latest part of the
    watermark's range; else every k-th row by a hash of all columns.
    """
    if rows <= large:
        return None, "full"
    k = max(round(1 / fraction), 1)
    for f in df.schema.fields:
        if is_key(f.name, f.dataType):
            return F.col(f.name) % k == 0, f"{f.name} % {k} = 0"
    if watermark and bounds:
        start = bounds[1] - timedelta(seconds=(bounds[1] - bounds[0]).total_seconds() * fraction)
        return F.col(watermark) >= F.lit(start.isoformat(sep=" ")).cast("timestamp_ntz"), f"{watermark} >= {start.isoformat(sep=' ')}"
    return F.pmod(F.xxhash64(*df.columns, F.lit(seed)), F.lit(k)) == 0, f"hash % {k} = 0"


def column_stats(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """A row a column: position, data_type, family, rows, null_count, null_rate, min, max, and lengths of strings.

    One pass. Lengths leave out trailing blanks. Minimum and maximum as text; none of columns named like identifiers.
    """
    fields = [f for f in df.schema.fields if columns is None or f.name in columns]
    parts = [F.count("*").alias("rows")]
    for i, f in enumerate(fields):
        c, kind = F.col(f"`{f.name}`"), family(f.dataType)
        shown = kind != "other" and not (is_identifier(f.name) and not is_key(f.name, f.dataType))
        length = F.length(F.rtrim(c)) if kind == "string" else F.lit(None).cast("int")
        parts.append(
            F.struct(
                F.count_if(c.isNull()).alias("null_count"),
                (F.min(c) if shown else F.lit(None)).cast("string").alias("min_value"),
                (F.max(c) if shown else F.lit(None)).cast("string").alias("max_value"),
                F.min(length).alias("min_length"),
                F.max(length).alias("max_length"),
                F.round(F.avg(length.cast("double")), 4).alias("avg_length"),
            ).alias(f"c{i}")
        )
    each = F.array(*(F.struct(F.lit(i + 1).alias("position"), F.lit(f.name).alias("column_name"), F.lit(f.dataType.simpleString()).alias("data_type"), F.lit(family(f.dataType)).alias("family"), F.lit(is_key(f.name, f.dataType)).alias("key_like"), F.col(f"c{i}").alias("s")) for i, f in enumerate(fields)))
    out = df.agg(*parts).select("rows", F.inline(each))
    return out.select("position", "column_name", "data_type", "family", "key_like", "rows", "s.*", F.when(F.col("rows") > 0, F.round(F.col("s.null_count") / F.col("rows"), 6)).alias("null_rate"))


def frequencies(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column_name, value, frequency) of every value, null too, of the columns: one pass and one shuffle."""
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("column_name"), text(f"`{c}`").alias("value")) for c in columns)))
    return df.select(pairs.alias("p")).groupBy("p.column_name", "p.value").agg(F.count("*").alias("frequency"))


def distinct_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column_name, distinct_count), nulls not counted; values are told apart by 128 bits, and these alone are shuffled."""
    each = F.array(*(F.struct(F.lit(i).alias("k"), F.xxhash64(F.col(f"`{c}`")).alias("a"), F.xxhash64(F.lit(i), F.col(f"`{c}`")).alias("b"), F.col(f"`{c}`").isNotNull().alias("there")) for i, c in enumerate(columns)))
    counts = df.select(F.inline(each)).where("there").groupBy("k", "a", "b").agg(F.lit(1)).groupBy("k").agg(F.count("*").alias("distinct_count"))
    names = df.sparkSession.createDataFrame(list(enumerate(columns)), "k int, column_name string")
    return names.join(counts, "k", "left").select("column_name", F.coalesce("distinct_count", F.lit(0)).alias("distinct_count"))


def top_values(freq: DataFrame, k: int = TOP_K, least: Column | None = None) -> DataFrame:
    """The k most frequent values of each column, ties by value with null first; least: a floor of the frequency."""
    by = Window.partitionBy("column_name").orderBy(F.desc("frequency"), F.col("value").asc_nulls_first())
    kept = freq if least is None else freq.where(F.col("frequency") >= least)
    return kept.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)


def rare_floor(rows: int) -> Column:
    """A value is shown only if that many rows have it."""
    return F.greatest(F.lit(RARE_RATE * rows), F.lit(float(RARE_COUNT)))


def key_sentinel(freq: DataFrame, share: float = SENTINEL_SHARE) -> DataFrame:
    """The most frequent value of each column if it has that share of the rows."""
    total = freq.groupBy("column_name").agg(F.sum("frequency").alias("rows"))
    return top_values(freq, 1).join(total, "column_name").where(F.col("frequency") >= share * F.col("rows")).select("column_name", "value", "frequency", "rows")


def _any(name: Column, patterns: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for p in patterns:
        out = out | F.contains(F.lower(name), F.lit(p))
    return out


def classified(stats: DataFrame) -> DataFrame:
    """stats (with distinct_count; null: not known) and column_class.

    In this order: key; named like an identifier, or free text; vocabulary; not known: identifier; few values:
    categorical; other strings: identifier; else a measure.
    """
    free = (F.col("family") == "string") & (F.coalesce("max_length", F.lit(0)) > FREE_TEXT_LENGTH)
    hidden = "identifier_or_freetext"
    kind = (
        F.when(F.col("key_like"), "key")
        .when(_any(F.col("column_name"), IDENTIFIER_PATTERNS) | free, hidden)
        .when(_any(F.col("column_name"), VOCABULARY_PATTERNS), "categorical_coded")
        .when(F.col("distinct_count").isNull(), hidden)
        .when(F.col("distinct_count") <= CATEGORICAL_CEILING, "categorical_coded")
        .when(F.col("family") == "string", hidden)
        .otherwise("measure")
    )
    return stats.withColumn("column_class", kind)


def profile(df: DataFrame) -> DataFrame:
    """column_stats with distinct counts and classes."""
    stats = column_stats(df)
    counted = [f.name for f in df.schema.fields if family(f.dataType) != "other"]
    joined = stats.join(distinct_counts(df, counted), "column_name", "left")
    return classified(joined.withColumn("distinct_count", F.when(F.col("rows") > 0, F.col("distinct_count"))))


def candidate_keys(stats: DataFrame) -> DataFrame:
    """Columns with as many distinct values as there are rows, and some rows; those named like keys first."""
    found = stats.where((F.col("distinct_count") == F.col("rows")) & (F.col("rows") > 0))
    return found.select("column_name", "distinct_count", "rows").orderBy(~F.col("column_name").rlike("(?i)(id|key)$"), "column_name")


def eligible_pairs(profiles: DataFrame, cap: int | None = None) -> DataFrame:
    """Column pairs worth a containment test: of one view or two, one type family, neither free text nor a measure, one key-like.

    profiles: view and the columns of `profile`; small, a row a column. budget: all pairs are evaluated; with a cap
    (PAIR_CAP is the usual one) the first `cap` pairs, and the rest skipped for their cost.
    """
    keyish = (F.col("column_class") == "key") | F.col("column_name").rlike("(?i)id|code|key") | (F.col("distinct_count") >= KEY_UNIQUENESS * F.col("rows"))
    free = (F.col("family") == "string") & (F.coalesce("max_length", F.lit(0)) > FREE_TEXT_LENGTH)
    cols = profiles.where(F.col("family").isin("numeric", "string") & ~free & (F.col("column_class") != "measure")).select("view", "column_name", "family", F.coalesce(keyish, F.lit(False)).alias("keyish"))
    a, b = cols.alias("a"), cols.alias("b")
    on = (F.col("a.family") == F.col("b.family")) & (F.struct("a.view", "a.column_name") < F.struct("b.view", "b.column_name")) & (F.col("a.keyish") | F.col("b.keyish"))
    pairs = a.join(b, on).select(F.col("a.view").alias("view_a"), F.col("a.column_name").alias("column_a"), F.col("b.view").alias("view_b"), F.col("b.column_name").alias("column_b"))
    if cap is None:
        return pairs.withColumn("budget", F.lit("evaluated"))
    n = F.row_number().over(Window.orderBy("view_a", "column_a", "view_b", "column_b"))
    return pairs.withColumn("budget", F.when(n <= cap, "evaluated").otherwise("skipped_cost"))


def considered_pairs(profiles: DataFrame) -> int:
    """How many pairs of columns there are before any is pruned."""
    n = profiles.count()
    return n * (n - 1) // 2


def containment(a: DataFrame, column_a: str, b: DataFrame, column_b: str) -> DataFrame:
    """One row: distinct values on each side, those in both, orphans and containment each way.

    One full outer join of the two distinct sets serves both directions.
    """
    x = a.select(F.col(column_a).alias("v")).where("v IS NOT NULL").distinct().withColumn("in_a", F.lit(1))
    y = b.select(F.col(column_b).alias("v")).where("v IS NOT NULL").distinct().withColumn("in_b", F.lit(1))
    n = x.join(y, "v", "full_outer").agg(F.count("in_a").alias("distinct_a"), F.count("in_b").alias("distinct_b"), F.count_if(F.col("in_a").isNotNull() & F.col("in_b").isNotNull()).alias("common"))
    rate = lambda d: F.when(F.col(d) > 0, F.round(F.col("common") / F.col(d), 6))
    return n.select("distinct_a", "distinct_b", "common", (F.col("distinct_a") - F.col("common")).alias("orphans_a"), (F.col("distinct_b") - F.col("common")).alias("orphans_b"), rate("distinct_a").alias("containment_a"), rate("distinct_b").alias("containment_b"))


def containments(views: dict[str, DataFrame], pairs: list[tuple[str, str, str, str]]) -> DataFrame:
    """containment of many pairs (view_a, column_a, view_b, column_b) in one job.

    A view is read once, however many of its columns are asked for. A value's columns are bits of a few numbers, which
    combine before the one shuffle; values with the same columns are then counted together, and each such count stands
    for all pairs of its columns. Numbers compare as numbers.
    """
    columns = list(dict.fromkeys([(v, c) for a, x, b, y in pairs for v, c in ((a, x), (b, y))]))
    spark, values = next(iter(views.values())).sparkSession, None
    for v in dict.fromkeys(v for v, _ in columns):
        each = []
        for n, c in ((n, c) for n, (w, c) in enumerate(columns) if w == v):
            kind = family(views[v].schema[c].dataType)
            value = F.concat(F.lit(f"{kind}:"), (F.col(c).cast("decimal(38,6)") if kind == "numeric" else F.col(c)).cast("string"))
            each.append(F.struct(value.alias("value"), F.lit(n).alias("k")))
        one = views[v].select(F.inline(F.array(*each))).where("value IS NOT NULL")
        values = one if values is None else values.unionByName(one)
    words = [f"w{i}" for i in range(-(-len(columns) // 62))]
    bit = lambda i: F.when(F.floor(F.col("k") / 62) == i, F.expr("shiftleft(1L, k % 62)")).otherwise(F.lit(0).cast("long"))
    masks = values.groupBy("value").agg(*(F.bit_or(bit(i)).alias(w) for i, w in enumerate(words))).groupBy(*words).count()
    of = lambda w, i: F.transform(F.filter(F.sequence(F.lit(0), F.lit(61)), lambda p: F.getbit(F.col(w), p) == 1), lambda p: p + 62 * i)
    sets = masks.select("count", F.flatten(F.array(*(of(w, i) for i, w in enumerate(words)))).alias("ks"))
    both = sets.select("count", F.explode(F.flatten(F.transform("ks", lambda a: F.transform(F.filter("ks", lambda b: b >= a), lambda b: F.struct(a.alias("a"), b.alias("b")))))).alias("p"))
    counts = both.groupBy("p.a", "p.b").agg(F.sum("count").alias("n"))
    at = {c: n for n, c in enumerate(columns)}
    asked = spark.createDataFrame([(a, x, b, y, at[a, x], at[b, y], min(at[a, x], at[b, y]), max(at[a, x], at[b, y])) for a, x, b, y in pairs], "view_a string, column_a string, view_b string, column_b string, ka int, kb int, low int, high int")
    own = counts.where("a = b")
    out = asked.join(own.select(F.col("a").alias("ka"), F.col("n").alias("distinct_a")), "ka", "left").join(own.select(F.col("a").alias("kb"), F.col("n").alias("distinct_b")), "kb", "left")
    out = out.join(counts.select(F.col("a").alias("low"), F.col("b").alias("high"), F.col("n").alias("common")), ["low", "high"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    rate = lambda d: F.when(zero(d) > 0, F.round(zero("common") / F.col(d), 6))
    return out.select("view_a", "column_a", "view_b", "column_b", zero("distinct_a").alias("distinct_a"), zero("distinct_b").alias("distinct_b"), zero("common").alias("common"), (zero("distinct_a") - zero("common")).alias("orphans_a"), (zero("distinct_b") - zero("common")).alias("orphans_b"), rate("distinct_a").alias("containment_a"), rate("distinct_b").alias("containment_b"))


def watermark_fitness(df: DataFrame, columns: list[str], as_of: datetime, baselines: dict[str, datetime] | None = None, names: tuple[str, ...] = WATERMARK_NAMES) -> DataFrame:
    """(column_name, null_count, min_value, max_value, fit, reason): whether a column can carry a high-water mark.

    It must be a time column by one of the names, without nulls, not behind its earlier maximum, and no more than a day ahead.
    """
    fields = [f for f in df.schema.fields if f.name in columns]
    parts = [F.struct(F.count_if(F.col(f.name).isNull()).alias("null_count"), F.min(f.name).cast("string").alias("min_value"), F.max(f.name).cast("string").alias("max_value")).alias(f"c{i}") for i, f in enumerate(fields)]
    each = [F.struct(F.lit(f.name).alias("column_name"), F.lit(family(f.dataType)).alias("family"), F.lit((baselines or {}).get(f.name)).cast("timestamp_ntz").alias("baseline"), F.col(f"c{i}").alias("s")) for i, f in enumerate(fields)]
    out = df.agg(*parts).select(F.inline(F.array(*each)))
    reason = (
        F.when(F.col("family") != "date", "wrong_type")
        .when(F.col("s.null_count") > 0, "null_values_present")
        .when(F.expr("try_cast(s.max_value AS timestamp_ntz)") < F.col("baseline"), "non_monotonic_vs_baseline")
        .when(F.expr("try_cast(s.max_value AS timestamp_ntz)") > F.lit(as_of + timedelta(days=1)).cast("timestamp_ntz"), "future_dated_max")
    )
    return out.select("column_name", "s.*", reason.isNull().alias("fit"), reason.alias("reason"))


def sentinels(stats: DataFrame, tops: DataFrame) -> DataFrame:
    """(column_name, sentinel_type, value, frequency) of suspicious values.

    stats: the profile; tops: top values of its columns. Placeholder dates at either end of a range; a key at or below
    zero; empty strings beside nulls; a value that dominates all others.
    """
    null = F.lit(None).cast("long")
    ends = stats.where("family = 'date'").select("column_name", F.explode(F.array("min_value", "max_value")).alias("value")).distinct()
    dates = ends.where(F.substring("value", 1, 10).isin(*PLACEHOLDER_DATES)).select("column_name", F.lit("placeholder_date").alias("sentinel_type"), "value", null.alias("frequency"))
    first = tops.where("rank = 1").select("column_name", F.col("value").alias("v1"), F.col("frequency").alias("f1"))
    second = tops.where("rank = 2").select("column_name", F.col("frequency").alias("f2"))
    ids = stats.where("column_class = 'key' AND try_cast(min_value AS decimal(38,0)) <= 0").join(first, "column_name", "left")
    ids = ids.select("column_name", F.lit("zero_or_negative_id").alias("sentinel_type"), F.col("min_value").alias("value"), F.when(F.col("v1") == F.col("min_value"), F.col("f1")).alias("frequency"))
    coded = stats.where("column_class IN ('categorical_coded', 'reference_vocabulary')")
    empty = coded.where("null_count > 0").join(tops.where("value = ''"), "column_name").select("column_name", F.lit("empty_string_overload").alias("sentinel_type"), "value", "frequency")
    magic = coded.where("column_class = 'categorical_coded'").join(first, "column_name").join(second, "column_name")
    magic = magic.where((F.coalesce("v1", F.lit("NULL")) != "") & (F.col("f1") >= MAGIC_LEAST) & (F.col("f1") >= MAGIC_RATIO * F.col("f2"))).select("column_name", F.lit("magic_value").alias("sentinel_type"), F.coalesce("v1", F.lit("NULL")).alias("value"), F.col("f1").alias("frequency"))
    return dates.unionByName(ids).unionByName(empty).unionByName(magic)


def test_indicators(df: DataFrame, columns: tuple[str, ...] = TEST_FLAGS) -> DataFrame:
    """(column_name, prevalence_count, prevalence_rate) of flags by one of the names."""
    own = [c for c in df.columns if c.lower() in columns]
    parts = [F.count_if(F.lower(text(c)).isin(*TRUE_TOKENS)).alias(f"c{i}") for i, c in enumerate(own)]
    each = F.array(*(F.struct(F.lit(c).alias("column_name"), F.col(f"c{i}").alias("prevalence_count")) for i, c in enumerate(own)))
    return df.agg(F.count("*").alias("rows"), *parts).select("rows", F.inline(each)).select("column_name", "prevalence_count", F.when(F.col("rows") > 0, F.round(F.col("prevalence_count") / F.col("rows"), 6)).alias("prevalence_rate"))


def archetype(stats: DataFrame, names: list[str], families: dict[str, str]) -> DataFrame:
    """One row: reference or fact, with the signals.

    A reference view has a key, a near-unique name column, no patient linkage and no date but audit timestamps.
    """
    linked = any(p in n.lower() for n in names for p in LINKAGE_PATTERNS)
    dated = any(families[n] == "date" and not any(p in n.lower() for p in AUDIT_PATTERNS) for n in names)
    free = F.coalesce("max_length", F.lit(0)) > FREE_TEXT_LENGTH
    pool = stats.where((F.col("family") == "string") & ~F.col("key_like") & ~_any(F.col("column_name"), IDENTIFIER_PATTERNS) & ~free & (F.col("rows") > 0))
    best = pool.select("column_name", F.round(F.col("distinct_count") / F.col("rows"), 6).alias("uniqueness"), "position").agg(F.max(F.struct("uniqueness", (-F.col("position")).alias("p"), "column_name")).alias("b"))
    out = best.crossJoin(stats.agg(F.coalesce(F.bool_or("key_like"), F.lit(False)).alias("has_key")))
    out = out.select("has_key", F.col("b.column_name").alias("name_column"), F.col("b.uniqueness").alias("uniqueness"), F.lit(linked).alias("linked"), F.lit(dated).alias("dated"))
    good = F.col("has_key") & (F.coalesce("uniqueness", F.lit(0.0)) >= NAME_UNIQUENESS) & ~F.col("linked") & ~F.col("dated")
    return out.withColumn("archetype", F.when(good, "reference").otherwise("fact"))


def reference_sample(df: DataFrame, name: str, key: str, n: int = REFERENCE_SAMPLES) -> DataFrame:
    """The first n non-null names in the order of the key."""
    return df.where(F.col(name).isNotNull()).orderBy(key, name).limit(n).select(F.col(key).alias("key"), F.col(name).alias("value"))


def trailing_tags(df: DataFrame, name: str, n: int = TRAILING_TAGS) -> DataFrame:
    """The n most frequent endings from the character before the last opening parenthesis on, ties by tag."""
    c = F.col(name)
    tag = F.right(c, F.locate("(", F.reverse(c)) + 1)
    tags = df.where(c.like("%(%)")).select(tag.alias("tag")).groupBy("tag").agg(F.count("*").alias("frequency"))
    return tags.orderBy(F.desc("frequency"), "tag").limit(n)


def families(df: DataFrame) -> dict[str, str]:
    return {f.name: family(f.dataType) for f in df.schema.fields}
