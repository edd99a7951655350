"""What happens between runs, over the state tables: reviewers' commands, precision, demotion, recalibration, verification.

Each job is a batch with an id. Its result lands once, however often the batch is sent: a snapshot is compared and swapped
under the batch's id, and a job that another writer overtook is made anew from the newer version. The configuration of
practices has a row a practice and check; a pair that has none yet gets one when a job first has something to say of it.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators import calibration, feedback, findings, reconcile
from plumbline.operators.run import KEPT, executions, history
from plumbline.plans.document import Check, CheckError, validate
from plumbline.sources import tables
from plumbline.sources.guard import Source
from plumbline.sources.state import Store

CONFIG = "practice_id string, check_id string, params map<string,string>, params_source string, demoted boolean, demoted_at timestamp_ntz, demotion_reason string"
PRECISION = "practice_id string, check_id string, n long, genuine long, precision double, computed_at timestamp_ntz"
DEMOTIONS = "practice_id string, check_id string, precision double, demotion_reason string"
#: applied: false where the parameters were set by hand and stay.
RECALIBRATIONS = "practice_id string, check_id string, param string, n long, before string, after double, applied boolean"


def _columns(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def _land(store: Store, name: str, schema: str, batch_id: str, keep: int, change: Callable[[DataFrame], DataFrame]) -> None:
    """Writes change(newest rows) as the next version, made anew until it follows the version it was made from."""
    while not any(v.by == batch_id for v in store.versions(name)):
        base = store.version(name)
        store.write(name, change(store.read(name, schema, base)), keep, base=base, by=batch_id)


def config(store: Store) -> DataFrame:
    return store.read("check_config", CONFIG)


def review(store: Store, commands: DataFrame, batch_id: str, *, strict: bool = True) -> DataFrame:
    """Applies commands (feedback.COMMANDS without run_id) to the findings and logs their events; gives the events.

    strict: FeedbackError if any is wrong, and nothing is applied; else the wrong ones are left out.
    """

    def change(before: DataFrame) -> DataFrame:
        after, events = feedback.apply(commands.withColumn("run_id", F.lit(batch_id)), before, strict=strict)
        store.append("events", events.select(_columns(findings.EVENTS)), batch_id)
        return after

    _land(store, "findings", findings.FINDINGS, batch_id, KEPT, change)
    return store.part("events", ", ".join(x for x in findings.EVENTS.split(", ") if not x.startswith("run_id")), batch_id)


def precision(store: Store, batch_id: str, as_of: datetime) -> DataFrame:
    """Precision of each pair over its last coded dismissals, of all logged events; kept as a part of a log."""
    if not store.has("precision", batch_id):
        coded = calibration.dismissals(history(store), store.read("findings", findings.FINDINGS))
        found = calibration.precision(coded).withColumn("computed_at", F.lit(as_of).cast("timestamp_ntz"))
        store.append("precision", found.select(_columns(PRECISION)), batch_id)
    return store.part("precision", PRECISION, batch_id)


def demote(store: Store, batch_id: str, as_of: datetime, *, floor: float = calibration.FLOOR, dry_run: bool = False) -> DataFrame:
    """Demotes the pairs whose latest precision lies below the floor; gives them. Nothing is promoted again."""
    stats = store.log("precision", PRECISION)
    if dry_run:
        return calibration.demotions(stats, config(store), floor).select(_columns(DEMOTIONS))

    def change(before: DataFrame) -> DataFrame:
        store.append("demotions", calibration.demotions(stats, before, floor).select(_columns(DEMOTIONS)), batch_id)
        return calibration.demoted(before, store.part("demotions", DEMOTIONS, batch_id), as_of).select(_columns(CONFIG))

    _land(store, "check_config", CONFIG, batch_id, 2, change)
    return store.part("demotions", DEMOTIONS, batch_id)


def recalibrate(store: Store, views: dict[str, DataFrame], checks: list[Check], batch_id: str, *, dry_run: bool = False) -> DataFrame:
    """Learns the percentile parameters of all configured pairs, and of pairs that a run has judged; gives the changes.

    Checks without such a parameter play no part. Parameters that were set by hand are reported and stay.
    """
    learning = [c for c in checks if any(p.strategy == "percentile" for p in c.params.values())]
    judged = executions(store).where("status = 'ok' AND practice_id IS NOT NULL").select("practice_id", "check_id").distinct()

    def pairs(before: DataFrame) -> DataFrame:
        """before, with a row for each judged pair of these checks."""
        new = judged.where(F.col("check_id").isin(*[c.id for c in learning])).join(before, ["practice_id", "check_id"], "left_anti")
        return before.unionByName(new, allowMissingColumns=True)

    def changes(known: DataFrame) -> DataFrame:
        out = store.spark.createDataFrame([], RECALIBRATIONS)
        for c in learning:
            own = known.where(F.col("check_id") == c.id)
            manual = F.col("params_source").eqNullSafe("manual")
            found = calibration.learned(c, views, own).withColumn("applied", F.lit(True))
            for name in (n for n, p in c.params.items() if p.strategy == "percentile"):
                none = F.lit(None)
                kept = own.where(manual).select("practice_id", F.lit(name).alias("param"), none.cast("long").alias("n"), F.col("params")[name].alias("before"), none.cast("double").alias("after"), F.lit(False).alias("applied"))
                found = found.unionByName(kept)
            out = out.unionByName(found.withColumn("check_id", F.lit(c.id)).select(_columns(RECALIBRATIONS)))
        return out

    if dry_run:
        return changes(pairs(config(store)))

    def change(before: DataFrame) -> DataFrame:
        known = pairs(before)
        store.append("recalibrations", changes(known), batch_id)
        done = store.part("recalibrations", RECALIBRATIONS, batch_id).where("applied")
        out = known.where(~F.col("check_id").isin(*[c.id for c in learning]))
        for c in learning:
            own = done.where(F.col("check_id") == c.id).select("practice_id", "param", "after")
            out = out.unionByName(calibration.merged(known.where(F.col("check_id") == c.id), own).select(_columns(CONFIG)))
        return out

    _land(store, "check_config", CONFIG, batch_id, 2, change)
    return store.part("recalibrations", RECALIBRATIONS, batch_id)


def verification(source: Source, exported: list[str] | None = None, timeout_s: float | None = None) -> dict[str, Any]:
    """What can be read now: Spark's version, each view with its kind and rows, and how the views match an exported list."""
    spark, seen = source.spark, tables.surface(source)
    rows = [r.asDict() for r in seen.orderBy("view").collect()]  # a row a view
    for r in rows:
        r["row_count"], r["row_status"] = tables.counted(source, r["view"], timeout_s) if r["can_select"] else (None, "indeterminate")
    matched = []
    if exported is not None:
        names = spark.createDataFrame([(v,) for v in exported], "view string")
        matched = [r.asDict() for r in reconcile.surface(names, seen).orderBy("view").collect()]
    ok = all(r["can_select"] for r in rows) and not any(m["status"] == "missing" for m in matched)
    return {"spark": spark.version, "ok": ok, "views": rows, "reconciliation": matched}


def verification_report(found: dict[str, Any]) -> str:
    lines = ["# Verification", "", f"Spark {found['spark']}, {'all is there' if found['ok'] else 'something is missing'}", "", "| view | kind | readable | rows | counted |", "|-|-|-|-|-|"]
    lines += [f"| {r['view']} | {r['kind']} | {'yes' if r['can_select'] else 'no'} | {'' if r['row_count'] is None else r['row_count']} | {r['row_status']} |" for r in found["views"]]
    if found["reconciliation"]:
        lines += ["", "| exported name | found |", "|-|-|", *(f"| {m['view']} | {m['status']} |" for m in found["reconciliation"])]
    return "\n".join(lines) + "\n"


def problems(source: Source, checks: list[Check]) -> dict[str, str]:
    """What is wrong with each check, of those with which something is."""
    out = {}
    for c in checks:
        try:
            validate(source.spark, c, source.columns())
        except CheckError as e:
            out[c.id] = str(e)
    return out
