"""Learning from reviews and data: trailing precision, demotion and learned parameters."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.operators.findings import latest
from plumbline.plans.document import Check

WINDOW, LEAST, FLOOR = 50, 10, 0.30


def precision(dismissals: DataFrame, window: int = WINDOW, least: int = LEAST) -> DataFrame:
    """(practice_id, check_id, n, genuine, precision) over the last `window` coded dismissals of each pair.

    dismissals: practice_id, check_id, reason_code, occurred_at, event_id (breaks ties). Pairs with fewer than `least` give no row.
    """
    by = Window.partitionBy("practice_id", "check_id").orderBy(F.desc("occurred_at"), F.desc("event_id"))
    recent = dismissals.where("reason_code IS NOT NULL").withColumn("k", F.row_number().over(by)).where(F.col("k") <= window)
    counted = recent.groupBy("practice_id", "check_id").agg(F.count("*").alias("n"), F.count_if(F.col("reason_code") == "genuine_issue").alias("genuine"))
    return counted.where(F.col("n") >= least).withColumn("precision", F.round(F.col("genuine") / F.col("n"), 6))


def active_pairs(dismissals: DataFrame) -> DataFrame:
    """(practice_id, check_id) with a coded dismissal."""
    return dismissals.where("reason_code IS NOT NULL").select("practice_id", "check_id").distinct()


def demotions(stats: DataFrame, config: DataFrame, floor: float = FLOOR) -> DataFrame:
    """Pairs to demote: the latest precision lies below the floor and the pair isn't demoted. Nothing is promoted again.

    stats: practice_id, check_id, precision, computed_at; config: practice_id, check_id, demoted.
    """
    last = latest(stats, ["practice_id", "check_id"], [F.desc("computed_at")])
    known = config.select("practice_id", "check_id", "demoted")
    pairs = last.where(F.col("precision") < floor).join(known, ["practice_id", "check_id"], "left")
    reason = F.format_string("precision %.4f below floor %.4f", F.col("precision").cast("double"), F.lit(floor))
    return pairs.where(~F.coalesce("demoted", F.lit(False))).select("practice_id", "check_id", "precision", reason.alias("demotion_reason"))


def demoted(config: DataFrame, found: DataFrame, at) -> DataFrame:
    """The config after demotion; pairs not yet configured get a row."""
    d = found.select("practice_id", "check_id", F.col("demotion_reason").alias("why"))
    both = config.join(d, ["practice_id", "check_id"], "full_outer")
    new = F.col("why").isNotNull()
    return both.withColumns({"demoted": new | F.coalesce("demoted", F.lit(False)), "demoted_at": F.when(new, F.lit(at)).otherwise(F.col("demoted_at")), "demotion_reason": F.coalesce("why", "demotion_reason")}).drop("why")


#: A measure is a function of named source views that gives (practice_id, value).
MEASURES: dict[str, Callable[[dict[str, DataFrame]], DataFrame]] = {}


def measure(name: str):
    """Registers a measure for percentile parameters."""

    def keep(f):
        MEASURES[name] = f
        return f

    return keep


def percentiles(values: DataFrame, p: float) -> DataFrame:
    """(practice_id, n, learned): the p-th percentile, interpolated, of each practice's values; all practices in one job.

    Equal values are counted before the shuffle, so a practice is as large as its number of different values.
    """
    own = Window.partitionBy("practice_id")
    counts = values.where("value IS NOT NULL").groupBy("practice_id", F.col("value").cast("double").alias("value")).agg(F.count("*").alias("c"))
    placed = counts.withColumns({"upto": F.sum("c").over(own.orderBy("value").rowsBetween(Window.unboundedPreceding, 0)), "n": F.sum("c").over(own)})
    at = F.lit(p / 100) * (F.col("n") - 1)  # between the values of two ranks
    there = lambda rank: F.max(F.when((F.col("upto") > rank) & (F.col("upto") - F.col("c") <= rank), F.col("value")))
    found = placed.groupBy("practice_id", "n").agg(there(F.floor(at)).alias("low"), there(F.ceil(at)).alias("high"))
    return found.select("practice_id", "n", (F.col("low") + (F.col("high") - F.col("low")) * (at - F.floor(at))).alias("learned"))


def dismissals(events: DataFrame, findings: DataFrame) -> DataFrame:
    """(practice_id, check_id, reason_code, occurred_at, event_id) of the coded dismissals among events, with their finding's practice."""
    coded = events.where("event = 'dismissed' AND reason_code IS NOT NULL")
    known = findings.select("check_id", "dedupe_key", "practice_id")
    return coded.join(known, ["check_id", "dedupe_key"]).select("practice_id", "check_id", "reason_code", "occurred_at", F.concat_ws(":", "run_id", "dedupe_key").alias("event_id"))


def learned(check: Check, views: dict[str, DataFrame], config: DataFrame, least: int = LEAST) -> DataFrame:
    """(practice_id, param, n, before, after): each percentile parameter of each practice, its fallback below `least` values.

    config: practice_id, params (map of strings), params_source. Manual settings stay.
    """
    out = None
    for name, param in check.params.items():
        if param.strategy != "percentile":
            continue
        if param.measure not in MEASURES:
            raise KeyError(f"unknown measure {param.measure!r}")
        found = percentiles(MEASURES[param.measure](views), param.p)
        found = found.withColumn("practice_id", F.col("practice_id").cast(config.schema["practice_id"].dataType))
        own = config.where("params_source IS DISTINCT FROM 'manual'").join(found, "practice_id", "left")
        after = F.when(F.coalesce("n", F.lit(0)) >= least, F.col("learned")).otherwise(F.lit(float(param.default)))
        one = own.select("practice_id", F.lit(name).alias("param"), F.coalesce("n", F.lit(0)).alias("n"), F.col("params")[name].alias("before"), after.alias("after"))
        out = one if out is None else out.unionByName(one)
    return out


def merged(config: DataFrame, changes: DataFrame) -> DataFrame:
    """config with the learned values merged into params."""
    new = changes.groupBy("practice_id").agg(F.map_from_entries(F.collect_list(F.struct("param", F.col("after").cast("string")))).alias("new"))
    old = F.coalesce("params", F.expr("map()").cast("map<string,string>"))
    params = F.when(F.col("new").isNull(), F.col("params")).otherwise(F.map_concat(F.map_filter(old, lambda k, _: ~F.array_contains(F.map_keys("new"), k)), "new"))
    source = F.when(F.col("new").isNotNull(), "learned").otherwise(F.col("params_source"))
    return config.join(new, "practice_id", "left").withColumns({"params": params, "params_source": source}).drop("new")


def params_of(row: Any) -> dict[str, Any]:
    """A practice's parameters as numbers where they are numbers."""
    out: dict[str, Any] = {}
    for k, v in (row or {}).items():
        try:
            out[k] = float(v)
        except (TypeError, ValueError):
            out[k] = v
    return out
