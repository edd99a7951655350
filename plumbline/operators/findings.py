"""Findings: an idempotent, set-based upsert of judged rows, with an append-only log of events.

A run's rows meet the findings in one full outer join; a row at a time is never looked up. Of a run only the relevant rows
get that far: fails, and passes of an entity that has an active finding. The rules:

    row             finding                        new status        event             counted as
    indeterminate   any                            -                 -                 -
    fail            none                           open              created           created
    fail            last seen by this run          -                 -                 skipped_idempotent
    fail            resolved_system                open              reseen            reopened
    fail            any other                      -                 reseen            reseen
    pass            open or acknowledged, seen by this run   -       -                 skipped_idempotent
    pass            open or acknowledged           resolved_system   resolved_system   resolved_system
    pass            none or any other              -                 -                 -

Evidence and last_seen_run change on a fail; a resolution keeps the evidence. Findings without a row stay untouched.
Several rows of one key count as one: fail before pass before indeterminate, then the smallest evidence.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FINDINGS = "check_id string, dedupe_key string, practice_id string, entity_key string, status string, evidence string, first_seen_run string, last_seen_run string, snoozed_until timestamp_ntz"
EVENTS = "check_id string, dedupe_key string, event string, run_id string, occurred_at timestamp_ntz, actor string, reason_code string, note string"
#: What transitions gives.
CHANGES = f"{FINDINGS}, event string, stat string"
ACTIVE = ("open", "acknowledged")


def dedupe_key(check_id: Column, entity_key: Column) -> Column:
    """SHA-256 of check id, a colon and the entity key's canonical JSON (keys sorted, no blanks)."""
    return F.sha2(F.concat(check_id, F.lit(":"), entity_key), 256)


def collapsed(rows: DataFrame) -> DataFrame:
    """One row a finding."""
    rank = F.when(F.col("tri_state") == "fail", 0).when(F.col("tri_state") == "pass", 1).otherwise(2)
    keyed = rows.select("check_id", dedupe_key(F.col("check_id"), F.col("entity_key")).alias("dedupe_key"), F.struct(rank.alias("rank"), "evidence", "practice_id", "tri_state", "entity_key").alias("r"))
    return keyed.groupBy("check_id", "dedupe_key").agg(F.min("r").alias("r")).select("check_id", "dedupe_key", F.col("r.practice_id").alias("practice_id"), F.col("r.entity_key").alias("entity_key"), F.col("r.tri_state").alias("tri_state"), F.col("r.evidence").alias("evidence"))


def relevant(rows: DataFrame, findings: DataFrame) -> DataFrame:
    """The rows that can change a finding: fails, and passes where a finding is active. One pass over rows."""
    active = findings.where(F.col("status").isin(*ACTIVE)).select(F.col("check_id").alias("_check"), F.col("entity_key").alias("_key")).distinct().withColumn("_active", F.lit(True))
    on = (F.col("check_id") == F.col("_check")) & (F.col("entity_key") == F.col("_key"))
    fail = F.col("tri_state") == "fail"
    kept = rows.where(F.col("tri_state").isin("fail", "pass")).join(active, on, "left").where(fail | F.col("_active"))
    return kept.withColumn("evidence", F.when(fail, F.col("evidence"))).drop("_check", "_key", "_active")


def relevant_of_written(rows: DataFrame, findings: DataFrame) -> DataFrame:
    """As relevant, of a written table: fails are read without a join, and passes meet the active findings in a semi-join."""
    active = findings.where(F.col("status").isin(*ACTIVE)).select("check_id", "entity_key").distinct()
    passes = rows.where("tri_state = 'pass'").join(active, ["check_id", "entity_key"], "left_semi")
    return rows.where("tri_state = 'fail'").unionByName(passes)


def transitions(rows: DataFrame, findings: DataFrame, run_id: str, *, auto_resolve: bool = True) -> DataFrame:
    """Each finding or new row, with its old and new state, event and stat (null: nothing happens)."""
    r, f = collapsed(rows).alias("r"), findings.alias("f")
    both = r.join(f, (F.col("r.check_id") == F.col("f.check_id")) & (F.col("r.dedupe_key") == F.col("f.dedupe_key")), "full_outer")
    state, old, seen = F.col("r.tri_state"), F.col("f.status"), F.col("f.last_seen_run") == run_id
    fail, passed = state == "fail", (state == "pass") & old.isin(*ACTIVE) & F.lit(auto_resolve)
    stat = F.when(fail & old.isNull(), "created").when((fail | passed) & seen, "skipped_idempotent").when(fail & (old == "resolved_system"), "reopened").when(fail, "reseen").when(passed, "resolved_system")
    event = F.when(stat.isin("created", "resolved_system"), stat).when(stat.isin("reopened", "reseen"), "reseen")
    touched = stat.isin("created", "reopened", "reseen")
    return both.select(
        F.coalesce("f.check_id", "r.check_id").alias("check_id"),
        F.coalesce("f.dedupe_key", "r.dedupe_key").alias("dedupe_key"),
        F.coalesce("f.practice_id", "r.practice_id").alias("practice_id"),
        F.coalesce("f.entity_key", "r.entity_key").alias("entity_key"),
        F.when(stat.isin("created", "reopened"), "open").when(stat == "resolved_system", "resolved_system").otherwise(old).alias("status"),
        F.when(touched, F.col("r.evidence")).otherwise(F.col("f.evidence")).alias("evidence"),
        F.when(stat == "created", run_id).otherwise(F.col("f.first_seen_run")).alias("first_seen_run"),
        F.when(touched | (stat == "resolved_system"), run_id).otherwise(F.col("f.last_seen_run")).alias("last_seen_run"),
        F.col("f.snoozed_until").alias("snoozed_until"),
        event.alias("event"),
        stat.alias("stat"),
    )


def snapshot(changes: DataFrame) -> DataFrame:
    """The findings after a run."""
    return changes.where("status IS NOT NULL").select(*[c.split()[0] for c in FINDINGS.split(", ")])


def events(changes: DataFrame, run_id: str, occurred_at) -> DataFrame:
    """The events of a run."""
    null = F.lit(None).cast("string")
    return changes.where("event IS NOT NULL").select("check_id", "dedupe_key", "event", F.lit(run_id).alias("run_id"), F.lit(occurred_at).cast("timestamp_ntz").alias("occurred_at"), F.lit("system").alias("actor"), null.alias("reason_code"), null.alias("note"))


def stats(changes: DataFrame) -> DataFrame:
    """(stat, n) of the transitions that happened."""
    return changes.where("stat IS NOT NULL").groupBy("stat").agg(F.count("*").alias("n"))


def latest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each group in an order."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__n = 1").drop("__n")
