"""Running checks: judged rows, tallies, scan windows, drift, and many checks over one scan."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from datetime import datetime, timedelta
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.plans.compiler import arrays, compile_check, compile_fused
from plumbline.plans.document import Check, default_params
from plumbline.sources.guard import Source

RUN_ROWS = "check_id string, practice_id string, entity_key string, tri_state string, evidence string"


def bound(check: Check, params: dict[str, Any] | None, as_of: datetime) -> dict[str, Any]:
    """Values of a statement's markers: defaults, then a practice's own; arrays by element."""
    sizes, out = arrays(check), {"as_of": as_of.isoformat(sep=" ")}
    for name, value in (default_params(check) | (params or {})).items():
        if name in sizes:
            value = check.params[name].value  # the statement has as many markers as the default has elements
            out |= {f"{name}_{i}": v for i, v in enumerate(value)}
        elif name in check.params:
            # a learned percentile may be fractional; an integer parameter is cut where it is used
            out[name] = int(value) if check.params[name].type == "integer" and value is not None else value
    return out


@dataclass(frozen=True)
class Window:
    """Rows of an increment: after from_ts (None: from the start), up to to_ts.

    full_partition: duplicates are looked for in the whole view, not only among these rows.
    """

    column: str
    from_ts: datetime | None
    to_ts: datetime
    full_partition: bool = False

    def args(self) -> dict[str, str | None]:
        return {"wm_from": self.from_ts.isoformat(sep=" ") if self.from_ts else None, "wm_to": self.to_ts.isoformat(sep=" ")}


def increment(column: str, high: datetime | None, now: datetime, lookback: timedelta = timedelta(0), full_partition: bool = False) -> Window:
    """From a stored high-water mark less a lookback to now; the first run is unbounded below."""
    return Window(column, None if high is None else high - lookback, now, full_partition)


def trailing(column: str, now: datetime, days: int = 30, full_partition: bool = False) -> Window:
    """The last so many days."""
    return Window(column, now - timedelta(days=days), now, full_partition)


def execute(source: Source, check: Check, *, as_of: datetime, params: dict[str, Any] | None = None, window: Window | None = None, practice_id: Any = None, run_id: str | None = None) -> DataFrame:
    """Judged rows: key and practice columns, tri_state, other evidence. Without practice_id, all practices' rows."""
    compiled = compile_check(check, watermark=window.column if window else None, practice_scope=practice_id is not None, full_partition=bool(window and window.full_partition))
    args = bound(check, params, as_of) | (window.args() if window else {}) | ({} if practice_id is None else {"practice_id": practice_id})
    return source.execute(compiled.sql, args, run_id=run_id)


def run_rows(source: Source, checks: list[Check], *, as_of: datetime, params: dict[str, dict[str, Any]] | None = None, windows: dict[str, Window] | None = None, run_id: str | None = None, slim: bool = False, conditions: dict[str, str] | None = None) -> DataFrame:
    """RUN_ROWS of many checks; checks of one view share its scan. slim: only check_id, practice_id and tri_state.

    conditions: SQL by view of the rows to judge.
    """
    by_view: dict[str, list[Check]] = {}
    for c in checks:
        by_view.setdefault(c.view, []).append(c)
    out = None
    for view, own in by_view.items():
        window = (windows or {}).get(view)
        args = {f"{n}__{k}": v for n, c in enumerate(own) for k, v in bound(c, (params or {}).get(c.id), as_of).items() if k != "as_of"}
        args |= {"as_of": as_of.isoformat(sep=" ")} | (window.args() if window else {})
        one = source.execute(compile_fused(own, watermark=window.column if window else None, slim=slim, full_partition=bool(window and window.full_partition), condition_sql=(conditions or {}).get(view)), args, run_id=run_id)
        out = one if out is None else out.unionByName(one)
    return out


def tally(rows: DataFrame, by: Iterable[str] = ("check_id", "practice_id")) -> DataFrame:
    """n_examined, n_fail, n_pass, n_indeterminate and the indeterminate rate of each group."""
    count = lambda s: F.count_if(F.col("tri_state") == s)
    return rows.groupBy(*by).agg(F.count("*").alias("n_examined"), count("fail").alias("n_fail"), count("pass").alias("n_pass"), count("indeterminate").alias("n_indeterminate"), F.round(count("indeterminate") / F.count("*"), 6).alias("indeterminate_rate"))


def indeterminacy_findings(tallies: DataFrame, threshold: float = 0.2) -> DataFrame:
    """RUN_ROWS of the system's own check: one row a checked pair, failing where its indeterminate rate is above threshold."""
    key = F.to_json(F.struct(F.col("check_id").alias("check_id"), F.col("practice_id").alias("practice_id")))
    state = F.when(F.col("indeterminate_rate") > threshold, "fail").otherwise("pass")
    evidence = F.to_json(F.struct("indeterminate_rate", "n_examined", "n_indeterminate"))
    return tallies.where("n_examined > 0").select(F.lit("system-indeterminacy-rate").alias("check_id"), "practice_id", key.alias("entity_key"), state.alias("tri_state"), evidence.alias("evidence"))


def drift(pinned: Iterable[str], live: Iterable[str]) -> list[str]:
    """Pinned columns that are gone; more live columns are no drift."""
    there = {c.lower() for c in live}
    return [c for c in pinned if c.lower() not in there]


def needed_columns(check: Check, columns: dict[str, list[str]]) -> dict[str, list[str]]:
    """Columns of a catalog that a check's views are pinned to."""
    return {v: columns.get(v, []) for v in check.views}


def key_set_hash(rows: DataFrame, key: str = "entity_key") -> DataFrame:
    """(n, hash) of the set of keys, whatever their order: count, xor and sum of 64-bit hashes of the distinct keys.

    Sums and xors combine before the shuffle; no list of keys is ever collected.
    """
    keys = rows.select(F.col(key).cast("string").alias("k")).distinct()
    h = F.conv(F.substring(F.md5("k"), 1, 15), 16, 10).cast("long")
    return keys.agg(F.count("*").alias("n"), F.coalesce(F.bit_xor(h), F.lit(0)).alias("xor"), F.coalesce(F.sum(h.cast("decimal(38,0)")), F.lit(0)).cast("string").alias("total")).select("n", F.sha2(F.concat_ws(":", F.col("n").cast("string"), F.col("xor").cast("string"), "total"), 256).alias("hash"))


def key_set_changed(previous: str | None, current: str) -> bool:
    """Whether a set of keys is another one than at the last run; without an earlier hash it counts as changed."""
    return previous != current


def escalates(watermarkable: bool, hot: bool) -> bool:
    """A view that changes all the time and has no watermark can't be read cheaply: its owners should be asked for one."""
    return hot and not watermarkable


def depends_on_now(check: Check) -> bool:
    """Whether time alone can change an outcome, so that an incremental scan can't stand for a full one."""
    return ":as_of" in compile_check(check).sql
