"""A whole run: all active checks of all views, findings, events, executions and a report.

What a run does is written part by part under its id, and each part is written once: its beginning with the time that now
stands for, the judged rows of each view, the executions and the moves of its views, the transitions, the next version of
the findings, the events, the marks, its end. A run that is repeated - after it broke off, or as a stream's batch that is
tried again - takes the parts that are there and adds those that are missing, so events are neither lost nor told twice.

A view is scanned once a run. All its rows come as narrow judged rows (a key; evidence only of fails), and tallies,
relevant rows and transitions are made of these. Transitions are made against a version of the findings, and the next
version is written only if that one is still the newest; otherwise the run makes them anew from its judged rows, so runs
that overlap all land. Marks and key sets of a view move on after that, and only if all its checks were judged.
"""

from __future__ import annotations

import time
from dataclasses import dataclass, field
from datetime import datetime, timedelta, timezone
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators import execute, findings, keysets
from plumbline.plans.compiler import table
from plumbline.plans.document import Check
from plumbline.sources.guard import Source
from plumbline.sources.state import Store

TALLIES = "check_id string, practice_id string, n_examined long, n_fail long, n_pass long, n_indeterminate long, indeterminate_rate double"
EXECUTIONS = f"{TALLIES}, strategy string, duration_ms double, status string, error string"
WATERMARKS = "view_name string, column_name string, value timestamp_ntz"
KEY_SETS = "view_name string, hash string"
RUNS = "trigger string, status string, started_at timestamp_ntz, ended_at timestamp_ntz, base_version int, checks int, errors int, as_of timestamp_ntz, run_id string"
_RUN = RUNS.rpartition(",")[0]
#: What a run keeps of the views it judged wholly: a mark to move a column to, or the hash of a key set.
MOVES = "view_name string, column_name string, value timestamp_ntz, hash string"
#: How a view's keys are dealt into ranges, and the ranges' sums; one table of each a view.
LAYOUTS = "key array<string>, low long, width long, buckets int"
MOST_EXPENSIVE = 5
#: Tallies that a report shows, and versions of the findings that stay for runs that still read them.
SHOWN, KEPT = 1000, 5


@dataclass(frozen=True)
class Plan:
    """How a view is read. column: a watermark, read from the stored mark on; else the last trailing_days by trailing_column,
    else everything. key: skip the view as long as its set of keys stays as it was. hot: it changes all the time. full_partition: rows that are
    read in part look for duplicates in the whole view. ranges: with a key, only those ranges of keys are read where keys
    came or went since the last run; findings of entities that are gone count as passed."""

    column: str | None = None
    trailing_column: str | None = None
    trailing_days: int = 30
    key: tuple[str, ...] = ()
    hot: bool = False
    full_partition: bool = False
    ranges: bool = False


@dataclass
class Report:
    run_id: str
    skipped_drift: dict[str, list[str]] = field(default_factory=dict)
    errors: dict[str, str] = field(default_factory=dict)
    stats: dict[str, int] = field(default_factory=dict)
    executions: list[dict[str, Any]] = field(default_factory=list)
    strategies: dict[str, str] = field(default_factory=dict)
    durations: dict[str, float] = field(default_factory=dict)
    asks: list[str] = field(default_factory=list)
    #: Tallies that executions leaves out.
    more: int = 0
    status: str = "completed"

    def expensive(self, n: int = MOST_EXPENSIVE) -> list[tuple[str, float]]:
        """The n views whose scans took longest, in milliseconds; the first known goes first on a tie."""
        return sorted(self.durations.items(), key=lambda x: -x[1])[:n]

    def markdown(self) -> str:
        lines = [f"# Run {self.run_id}", "", "| check | practice | examined | fail | pass | indeterminate |", "|-|-|-|-|-|-|"]
        lines += [f"| {e['check_id']} | {e['practice_id']} | {e['n_examined']} | {e['n_fail']} | {e['n_pass']} | {e['n_indeterminate']} |" for e in self.executions]
        lines += [f"| and {self.more} more | | | | | |"] * (self.more > 0)
        lines += ["", "Findings: " + (", ".join(f"{n} {s}" for s, n in sorted(self.stats.items())) or "no change")]
        lines += [f"Scan of {v}: {ms:.0f} ms, {self.strategies.get(v, '')}" for v, ms in self.expensive()]
        lines += [f"Skipped for drift: {c} (gone: {', '.join(cols)})" for c, cols in self.skipped_drift.items()]
        lines += [f"Failed: {c}: {e}" for c, e in self.errors.items()]
        lines += [f"Ask: {a}" for a in self.asks]
        return "\n".join(lines) + "\n"


def _shown(tallies: DataFrame) -> tuple[list[dict[str, Any]], int]:
    """The first SHOWN tallies, and how many more there are."""
    sums = (F.sum(c).alias(c) for c in ("n_examined", "n_fail", "n_pass", "n_indeterminate"))
    all_ = tallies.where("status = 'ok'").groupBy("check_id", "practice_id").agg(*sums)
    found = [r.asDict() for r in all_.orderBy("check_id", "practice_id").limit(SHOWN).collect()]
    return found, all_.count() - SHOWN if len(found) == SHOWN else 0


def _now() -> datetime:
    return datetime.now(timezone.utc).replace(tzinfo=None)


def run(source: Source, store: Store, checks: list[Check], *, run_id: str, as_of: datetime, pinned: dict[str, list[str]] | None = None, watermarks: dict[str, str] | None = None, lookback: timedelta = timedelta(days=1), params: dict[str, dict[str, Any]] | None = None, auto_resolve: bool = True, trigger: str = "manual", plans: dict[str, Plan] | None = None, timeout_s: float | None = None) -> Report:
    """Judges every check, upserts findings and appends events, executions and watermarks; a repeated run changes nothing.

    Checks whose pinned columns are gone, or whose statement Spark refuses, are left out and reported. A view is read as
    its plan says (watermarks is short for plans with a column); a view with a watermark is read from its stored mark less
    the lookback, unless a check of it depends on the as-of time. timeout_s: a view whose scan takes longer is cancelled,
    and its checks are reported as errors. Where a scan fails, the view's checks are judged one by one. A run that is taken
    up keeps the as-of time that it began with.
    """
    spark, report = source.spark, Report(run_id)
    if store.has("ended", run_id):
        done = store.part("executions", EXECUTIONS, run_id)
        kept = store.part("changes", findings.CHANGES, run_id).where("stat IS NOT NULL").count() if store.has("changes", run_id) else 0
        report.stats = {"skipped_idempotent": kept} if kept else {}
        report.executions, report.more = _shown(done)
        return report
    if not store.has("began", run_id):
        begun = [(trigger, "running", _now(), None, store.version("findings"), len(checks), 0, as_of)]
        store.append("began", spark.createDataFrame(begun, _RUN), run_id)
    base = store.part("began", _RUN, run_id).first()
    as_of = base["as_of"] or as_of
    if not store.has("executions", run_id):
        _judge_all(source, store, checks, run_id, as_of, pinned, {v: Plan(c) for v, c in (watermarks or {}).items()} | (plans or {}), lookback, params, report, timeout_s)
    else:
        for r in store.part("executions", EXECUTIONS, run_id).where("status <> 'ok'").collect():  # a row a check at most
            if r["status"] == "error":
                report.errors[r["check_id"]] = r["error"]
            else:
                report.skipped_drift[r["check_id"]] = r["error"].split(", ")
    _land(store, run_id, base["base_version"], auto_resolve)
    changes = store.part("changes", findings.CHANGES, run_id)
    if not store.has("events", run_id):
        store.append("events", findings.events(changes, run_id, as_of), run_id)
    moves = store.part("moves", MOVES, run_id).collect()  # a row a view
    _advance(store, "watermarks", WATERMARKS, [(m["view_name"], m["column_name"], m["value"]) for m in moves if m["column_name"]], 2)
    _advance(store, "key_sets", KEY_SETS, [(m["view_name"], m["hash"]) for m in moves if m["hash"]], 1)
    for m in moves:
        if not m["column_name"] and not m["hash"]:
            name = table(m["view_name"])
            store.write(f"key_sums__{name}", store.part("key_sums", keysets.SUMMARY, f"{run_id}--{name}"))
    report.stats = {r["stat"]: r["n"] for r in findings.stats(changes).collect()}
    report.executions, report.more = _shown(store.part("executions", EXECUTIONS, run_id))
    report.status = "completed_with_errors" if report.errors else "completed"
    ended = [(base["trigger"], report.status, base["started_at"], _now(), base["base_version"], len(checks), len(report.errors), as_of)]
    store.append("ended", spark.createDataFrame(ended, _RUN), run_id)
    source.flush()
    for name in ("judged", "key_sums"):
        for part in store.parts(name, f"{run_id}--"):
            store.remove(name, part)
    return report


def _judge_all(source: Source, store: Store, checks: list[Check], run_id: str, as_of: datetime, pinned: dict[str, list[str]] | None, plans: dict[str, Plan], lookback: timedelta, params: dict[str, dict[str, Any]] | None, report: Report, timeout_s: float | None) -> None:
    """Writes the judged rows of each view, then the moves of the views that were judged wholly and the executions."""
    spark, ready, live = source.spark, [], source.columns()
    for c in checks:
        gone = [x for v in c.views for x in execute.drift((pinned or live).get(v, []), live.get(v, []))]
        if gone:
            report.skipped_drift[c.id] = gone
            continue
        try:
            execute.execute(source, c, as_of=as_of, params=(params or {}).get(c.id), run_id=run_id)
            ready.append(c)
        except Exception as e:  # noqa: BLE001  one broken check doesn't stop the others
            report.errors[c.id] = str(e).splitlines()[0]
    windows, hashes, ready = _windows(source, store, ready, plans, as_of, lookback, report)
    conditions, ready = _ranges(source, store, ready, plans, run_id, report)
    tallies = _judged(source, store, ready, as_of, params, windows, conditions, run_id, report, timeout_s)
    whole = {c.view for c in checks} - {c.view for c in checks if c.id in report.errors or c.id in report.skipped_drift}
    moves = [(v, w.column, as_of, None) for v, w in windows.items() if v in whole and plans.get(v, Plan()).column == w.column]
    moves += [(v, None, None, h) for v, h in hashes.items() if v in whole]
    moves += [(v, None, None, None) for v in {c.view for c in checks} & whole if store.has("key_sums", f"{run_id}--{table(v)}")]
    store.append("moves", spark.createDataFrame(moves, MOVES), run_id)
    failed = [(c, None, 0, 0, 0, 0, None, None, None, "error", e) for c, e in report.errors.items()]
    failed += [(c, None, 0, 0, 0, 0, None, None, None, "skipped_drift", ", ".join(gone)) for c, gone in report.skipped_drift.items()]
    rows = spark.createDataFrame(failed, EXECUTIONS)
    store.append("executions", rows if tallies is None else tallies.unionByName(rows), run_id)


def _windows(source: Source, store: Store, ready: list[Check], plans: dict[str, Plan], as_of: datetime, lookback: timedelta, report: Report) -> tuple[dict[str, execute.Window], dict[str, str], list[Check]]:
    """Windows of the views that are read in part, key-set hashes to keep, and the checks whose views are read at all."""
    marks = {(r["view_name"], r["column_name"]): r["value"] for r in store.read("watermarks", WATERMARKS).collect()}  # a row a view
    known = {r["view_name"]: r["hash"] for r in store.read("key_sets", KEY_SETS).collect()}
    windows, hashes, unchanged = {}, {}, set()
    for view in sorted({c.view for c in ready}):
        plan = plans.get(view, Plan())
        timeless = not any(execute.depends_on_now(c) for c in ready if c.view == view)
        report.strategies[view] = "full_scan"
        if plan.column and timeless:
            report.strategies[view] = "increment"
            windows[view] = execute.increment(plan.column, marks.get((view, plan.column)), as_of, lookback, plan.full_partition)
        elif plan.trailing_column:
            report.strategies[view] = "trailing"
            windows[view] = execute.trailing(plan.trailing_column, as_of, plan.trailing_days, plan.full_partition)
        elif plan.key and not plan.ranges:
            hashes[view] = execute.key_set_hash(source.views[view].select(F.to_json(F.struct(*sorted(plan.key))).alias("entity_key"))).first()["hash"]
            if timeless and not execute.key_set_changed(known.get(view), hashes[view]):
                report.strategies[view] = "unchanged"
                unchanged.add(view)
        if execute.escalates(plan.column is not None, plan.hot):
            report.asks.append(f"{view} changes all the time and has no watermark; its owners should be asked for one")
    return windows, hashes, [c for c in ready if c.view not in unchanged]


def _ranges(source: Source, store: Store, ready: list[Check], plans: dict[str, Plan], run_id: str, report: Report) -> tuple[dict[str, str], list[Check]]:
    """Conditions on views that are read by ranges of keys, and the checks that are judged at all.

    Writes the view's sums, and passes for active findings whose entity is gone. A view without sums of a run before, or
    with a check that depends on the as-of time, is read in full.
    """
    conditions, unchanged, spark = {}, set(), source.spark
    for view in sorted({c.view for c in ready}):
        plan, name = plans.get(view, Plan()), table(view)
        if not (plan.key and plan.ranges) or plan.column or plan.trailing_column:
            continue
        kept = store.read(f"key_layout__{name}", LAYOUTS).first()
        where = keysets.Layout(tuple(kept["key"]), kept["low"], kept["width"], kept["buckets"]) if kept else keysets.layout(source.views[view], plan.key)
        if not kept:
            store.write(f"key_layout__{name}", spark.createDataFrame([(list(where.key), where.low, where.width, where.buckets)], LAYOUTS))
        store.append("key_sums", keysets.summary(source.views[view], where), f"{run_id}--{name}")
        timeless = not any(execute.depends_on_now(c) for c in ready if c.view == view)
        if not timeless or not store.version(f"key_sums__{name}"):
            continue
        new = store.part("key_sums", keysets.SUMMARY, f"{run_id}--{name}")
        buckets = [r["bucket"] for r in keysets.changed(store.read(f"key_sums__{name}", keysets.SUMMARY), new).collect()]  # a row a range
        report.strategies[view] = "ranges" if buckets else "unchanged"
        if not buckets:
            unchanged.add(view)
            continue
        # a null key is in no range, so a change of such keys asks for all of the view
        if None not in buckets:
            conditions[view] = where.condition(buckets)
            own = {c.id for c in ready if c.view == view and set(c.key) == set(where.key)}
            active = store.read("findings", findings.FINDINGS).where(F.col("check_id").isin(*own) & F.col("status").isin(*findings.ACTIVE)) if own else None
            if active is not None:
                gone = keysets.vanished(active.select("check_id", "practice_id", "entity_key"), source.views[view], where, buckets)
                store.append("judged", gone.select("check_id", "practice_id", "entity_key", F.lit("pass").alias("tri_state"), F.lit(None).cast("string").alias("evidence")), f"{run_id}--{name}--gone")
    return conditions, [c for c in ready if c.view not in unchanged]


def _judged(source: Source, store: Store, ready: list[Check], as_of: datetime, params, windows: dict[str, execute.Window], conditions: dict[str, str], run_id: str, report: Report, timeout_s: float | None) -> DataFrame | None:
    """Writes the judged rows, view by view, in one scan each; gives the tallies of each check and practice.

    A view whose scan fails is judged check by check, so that one check's failing row doesn't hide the others' findings.
    """
    out = None

    def judge(own: list[Check], part: str) -> str | None:
        """What went wrong, if anything did."""
        if store.has("judged", part):
            return None
        rows = execute.run_rows(source, own, as_of=as_of, params=params, windows=windows, conditions=conditions, run_id=run_id)
        kept = rows.withColumn("evidence", F.when(F.col("tri_state") == "fail", F.col("evidence")))

        def write() -> bool:
            store.append("judged", kept, part)
            return True

        try:
            return None if source.within(timeout_s, write) else f"the scan of {own[0].view} took more than {timeout_s} s"
        except Exception as e:  # noqa: BLE001  one broken view doesn't stop the others
            return str(e).splitlines()[0]

    for view in dict.fromkeys(c.view for c in ready):
        own, at = [c for c in ready if c.view == view], time.perf_counter()
        parts = [f"{run_id}--{table(view)}"]
        failed = judge(own, parts[0])
        if failed and len(own) > 1 and "took more than" not in failed:
            parts = [f"{run_id}--{table(view)}--{c.id}" for c in own]
            report.errors |= {c.id: e for c, p in zip(own, parts) if (e := judge([c], p))}
        elif failed:
            report.errors |= {c.id: failed for c in own}
        parts = [p for p in parts if store.has("judged", p)]
        report.durations[view] = (time.perf_counter() - at) * 1000
        for p in parts:
            one = execute.tally(store.part("judged", execute.RUN_ROWS, p))
            one = one.select("*", F.lit(report.strategies.get(view)).alias("strategy"), F.lit(report.durations[view]).alias("duration_ms"), F.lit("ok").alias("status"), F.lit(None).cast("string").alias("error"))
            out = one if out is None else out.unionByName(one)
    return out


def _land(store: Store, run_id: str, since: int, auto_resolve: bool) -> None:
    """Makes the run's transitions and writes the findings after them, against the newest version, until that stands.

    A run that broke off after its version was written finds that version by its id.
    """
    while not any(v.by == run_id for v in store.versions("findings", since)):
        base = store.version("findings")
        before = store.read("findings", findings.FINDINGS, base)
        counted = store.part("executions", EXECUTIONS, run_id).where("status = 'ok'")
        rows = findings.relevant(execute.indeterminacy_findings(counted), before)
        for p in store.parts("judged", f"{run_id}--"):
            rows = rows.unionByName(findings.relevant_of_written(store.part("judged", execute.RUN_ROWS, p), before))
        store.append("changes", findings.transitions(rows, before, run_id, auto_resolve=auto_resolve), run_id)
        changes = store.part("changes", findings.CHANGES, run_id)
        if store.write("findings", findings.snapshot(changes), KEPT, base=base, by=run_id):
            break


def _advance(store: Store, name: str, schema: str, new: list[tuple], keys: int) -> None:
    """Replaces the rows that share their first columns with new ones; a mark doesn't move back. Overlapping runs both land."""
    landed = not new
    while not landed:
        base = store.version(name)
        old = {tuple(r)[:keys]: tuple(r) for r in store.read(name, schema, base).collect()}  # a row a view
        for n in new:
            before = old.get(n[:keys])
            if name != "watermarks" or before is None or before[-1] is None or before[-1] < n[-1]:
                old[n[:keys]] = n
        landed = store.write(name, store.spark.createDataFrame([*old.values()], schema), base=base) is not None


def runs(store: Store) -> DataFrame:
    """All runs with trigger, status, start, end and counts; a run without an end is running or broke off."""
    began, ended = (store.log(n, _RUN) for n in ("began", "ended"))
    return ended.unionByName(began.join(ended.select("run_id"), "run_id", "left_anti"))


def executions(store: Store) -> DataFrame:
    """The executions of all runs."""
    return store.log("executions", EXECUTIONS)


def history(store: Store) -> DataFrame:
    """All events of all runs."""
    return store.log("events", ", ".join(x for x in findings.EVENTS.split(", ") if not x.startswith("run_id")))
