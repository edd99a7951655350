"""Which checks run where, and how drafts enter."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest_versions(versions: DataFrame) -> DataFrame:
    """The newest version of each check, with its other columns; combines before the shuffle."""
    others = [c for c in versions.columns if c not in ("check_id", "version_number")]
    row = F.max(F.struct("version_number", *others)).alias("v")
    return versions.groupBy("check_id").agg(row).select("check_id", "v.*")


def active_checks(checks: DataFrame, versions: DataFrame, config: DataFrame) -> DataFrame:
    """A row for each active check and practice that it is enabled for and not demoted in.

    checks: check_id, status; versions: check_id, version_number; config: practice_id, check_id, enabled, demoted.
    """
    live = checks.where("status = 'active' AND check_id NOT LIKE 'system-%'")
    return live.join(latest_versions(versions), "check_id").join(config.where("enabled AND NOT demoted"), "check_id")


def new_drafts(drafts: DataFrame, known: DataFrame, by: str = "slug") -> DataFrame:
    """Drafts whose slug isn't known yet."""
    return drafts.join(known, by, "left_anti")
