"""What a status page shows, as DataFrames over state tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators.findings import latest


def checks_by_status(checks: DataFrame, practice: str | None = None) -> DataFrame:
    """Checks of each status and source; with a column of practices, also how many these are."""
    more = [F.count_distinct(practice).alias("practices")] if practice else []
    return checks.groupBy("status", "source").agg(F.count("*").alias("checks"), *more)


def enabled_checks(config: DataFrame, checks: DataFrame) -> DataFrame:
    """Practices in which each active check is enabled and not demoted."""
    on = config.where("enabled AND NOT demoted").join(checks.where("status = 'active'").select("check_id", "title"), "check_id")
    return on.groupBy("check_id", "title").agg(F.count_distinct("practice_id").alias("practices"))


def narratives(composed: DataFrame, findings: DataFrame, checks: DataFrame, n: int = 20) -> DataFrame:
    """The last n narratives with their finding's status and check's title, ties by finding; needs composed_at and text."""
    own = composed.join(findings.select("check_id", "dedupe_key", F.col("status").alias("finding_status")), ["check_id", "dedupe_key"]).join(checks.select("check_id", "title"), "check_id")
    return own.orderBy(F.desc("composed_at"), "check_id", "dedupe_key").select("check_id", "title", "dedupe_key", "finding_status", "composed_at", "text").limit(n)


def calibrations(changes: DataFrame, checks: DataFrame, n: int = 20) -> DataFrame:
    """The last n learned parameters with their check's title; needs check_id, practice_id, param, before, after and computed_at."""
    own = changes.join(checks.select("check_id", "title"), "check_id")
    return own.orderBy(F.desc("computed_at"), "check_id", "practice_id", "param").select("check_id", "title", "practice_id", "param", "before", "after", "computed_at").limit(n)


def findings_by_practice(findings: DataFrame) -> DataFrame:
    """Open, acknowledged, dismissed and resolved findings of each practice."""
    return findings.groupBy("practice_id").agg(*(F.count_if(F.col("status") == s).alias(s) for s in ("open", "acknowledged", "dismissed", "resolved_system")))


def recent_events(events: DataFrame, n: int = 20) -> DataFrame:
    """The last n events, ties by finding."""
    return events.orderBy(F.desc("occurred_at"), "check_id", "dedupe_key").limit(n)


def lowest_precision(stats: DataFrame, n: int = 10) -> DataFrame:
    """The n pairs with the lowest latest precision; needs computed_at."""
    return latest(stats, ["practice_id", "check_id"], [F.desc("computed_at")]).orderBy("precision", "practice_id", "check_id").limit(n)


def demoted_pairs(config: DataFrame, checks: DataFrame) -> DataFrame:
    """Demoted pairs with their check's title and the reason."""
    return config.where("demoted").join(checks.select("check_id", "title"), "check_id").select("practice_id", "check_id", "title", "demotion_reason")


def last_runs(executions: DataFrame, n: int = 10) -> DataFrame:
    """Rows judged and findings of the last n runs; needs run_id."""
    return executions.groupBy("run_id").agg(F.sum("n_examined").alias("examined"), F.sum("n_fail").alias("failed"), F.countDistinct("check_id").alias("checks")).orderBy(F.desc("run_id")).limit(n)
