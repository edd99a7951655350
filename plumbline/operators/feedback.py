"""What reviewers say: transitions of findings, applied as a set of commands."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators.findings import latest

REASONS = ("genuine_issue", "not_genuine")
COMMANDS = "check_id string, dedupe_key string, command string, reason_code string, actor string, note string, until timestamp_ntz, occurred_at timestamp_ntz, run_id string"


class FeedbackError(ValueError):
    """Commands that break a rule; nothing was applied."""


def judged(commands: DataFrame, findings: DataFrame) -> DataFrame:
    """Each command with its finding's status and what is wrong with it (null: nothing).

    A dismissal needs a known reason; only dismissed or snoozed findings reopen; a snooze needs an end.
    """
    f = findings.select("check_id", "dedupe_key", F.col("status").alias("old_status"), F.col("snoozed_until").alias("old_snooze"))
    c = F.col("command")
    wrong = (
        F.when(F.col("old_status").isNull(), "unknown_finding")
        .when(~c.isin("dismiss", "acknowledge", "snooze", "reopen"), "unknown_command")
        .when((c == "dismiss") & ~F.coalesce(F.col("reason_code").isin(*REASONS), F.lit(False)), "invalid_reason_code")
        .when((c == "snooze") & F.col("until").isNull(), "snooze_without_end")
        .when((c == "reopen") & (F.col("old_status") != "dismissed") & F.col("old_snooze").isNull(), "invalid_transition")
    )
    return commands.join(f, ["check_id", "dedupe_key"], "left").withColumn("wrong", wrong)


def apply(commands: DataFrame, findings: DataFrame, *, strict: bool = True) -> tuple[DataFrame, DataFrame]:
    """(findings, events) after at most one command a finding - the latest of several.

    strict: FeedbackError on any wrong command, before anything is applied; else wrong ones are left out.
    """
    now = judged(latest(commands, ["check_id", "dedupe_key"], [F.desc("occurred_at"), F.col("command")]), findings)
    if strict and (bad := now.where("wrong IS NOT NULL").select("dedupe_key", "command", "wrong").first()):
        raise FeedbackError(f"{bad['command']} on {bad['dedupe_key']}: {bad['wrong']}")
    good = now.where("wrong IS NULL")
    c = F.col("command")
    named = F.when(c == "dismiss", "dismissed").when(c == "acknowledge", "acknowledged").when(c == "snooze", "snoozed").otherwise("reopened")
    events = good.select("check_id", "dedupe_key", named.alias("event"), "run_id", "occurred_at", "actor", F.when(c == "dismiss", F.col("reason_code")).alias("reason_code"), "note")
    did = good.select("check_id", "dedupe_key", "command", "until")
    status = F.when(c == "dismiss", "dismissed").when(c == "acknowledge", "acknowledged").when(c == "reopen", "open").otherwise(F.col("status"))
    snoozed = F.when(c == "snooze", F.col("until")).when(c == "reopen", F.lit(None)).otherwise(F.col("snoozed_until"))
    after = findings.join(did, ["check_id", "dedupe_key"], "left").withColumns({"status": status, "snoozed_until": snoozed}).select(*findings.columns)
    return after, events


def reason_counts(dismissals: DataFrame) -> DataFrame:
    """Dismissals of each check by reason; needs check_id and reason_code."""
    return dismissals.where(F.col("reason_code").isNotNull()).groupBy("check_id").agg(F.count_if(F.col("reason_code") == "genuine_issue").alias("genuine_issue"), F.count_if(F.col("reason_code") == "not_genuine").alias("not_genuine"))
