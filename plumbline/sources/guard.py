"""The one way to the source: single SELECT statements over allowed views, each audited."""

from __future__ import annotations

import atexit
import functools
import json
import re
import threading
import time
import uuid
from collections.abc import Callable, Iterable
from dataclasses import asdict, dataclass, replace
from datetime import datetime, timezone
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from plumbline.plans.compiler import table

#: Schemas of metadata that may always be read.
METADATA = ("information_schema", "sys")


class GuardError(ValueError):
    """A statement isn't one SELECT over allowed views; nothing ran."""


@dataclass(frozen=True)
class AuditEvent:
    statement: str
    params: str
    started_at: str
    duration_ms: float
    rows: int | None
    component: str
    run_id: str | None


class JsonlSink:
    """Appends each event as a line of JSON."""

    def __init__(self, path: str):
        self.path = path

    def __call__(self, event: AuditEvent) -> None:
        with open(self.path, "a", encoding="utf-8") as f:
            f.write(json.dumps(asdict(event), sort_keys=True) + "\n")


#: Plan nodes of plain queries; anything else - commands, table functions, scripts - is refused.
QUERY_NODES = frozenset("Project Filter Aggregate Join Sort GlobalLimit LocalLimit Offset Distinct Union Except Intersect SubqueryAlias UnresolvedWith UnresolvedRelation UnresolvedHaving OneRowRelation UnresolvedInlineTable UnresolvedSubqueryColumnAliases Generate LateralJoin WithWindowDefinition Window Pivot Unpivot Deduplicate".split())
#: Functions that run code of the machine, and those that read what no view shows.
CODE = frozenset("reflect java_method try_reflect input_file_name input_file_block_start input_file_block_length".split())
#: A call as the parsed plan shows it, and a name that is only known once the statement is analysed.
_CALL, _LATE = re.compile(r"'((?:[\w`]+\.)*[\w`]+)\("), "expressionwithunresolvedidentifier("


@functools.cache
def _builtin(spark: SparkSession) -> frozenset[str]:
    """Names of Spark's own functions; functions that someone registered aren't among them."""
    return frozenset(r[0].lower() for r in spark.sql("SHOW SYSTEM FUNCTIONS").collect()) - CODE


class TableSink:
    """Keeps events and appends them to a Parquet table, `every` at a time, when flushed, and when the driver ends.

    A run flushes the sinks of its source; `with TableSink(...) as sink` does so at the end of a block.
    """

    def __init__(self, spark: SparkSession, path: str, every: int = 100):
        self.spark, self.path, self.every, self.held = spark, path, every, []
        atexit.register(self._last)

    def __enter__(self) -> TableSink:
        return self

    def __exit__(self, *_: Any) -> None:
        self.flush()

    def _last(self) -> None:
        """Writes what is left where the session still stands."""
        if self.held and self.spark.sparkContext._jsc and not self.spark.sparkContext._jsc.sc().isStopped():
            self.flush()

    def __call__(self, event: AuditEvent) -> None:
        self.held.append(event)
        if len(self.held) >= self.every:
            self.flush()

    def flush(self) -> None:
        if self.held:
            rows = [tuple(asdict(e).values()) for e in self.held]
            self.spark.createDataFrame(rows, "statement string, params string, started_at string, duration_ms double, rows long, component string, run_id string").write.mode("append").parquet(self.path)
            self.held = []


def relations(spark: SparkSession, sql: str) -> list[str]:
    """Names of the relations that one query reads; GuardError if it is anything but one query.

    A name that a WITH clause defines excuses relations below that clause, and after it in the clause, only.
    """
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    except Exception as e:
        raise GuardError(f"not one statement that Spark reads: {str(e).splitlines()[0]}") from e
    found: list[str] = []

    def walk(node: Any, known: frozenset[str]) -> None:
        kind = node.getClass().getSimpleName()
        if kind not in QUERY_NODES:
            raise GuardError(f"not a plain query: {kind}")
        for e in _each(node.expressions()):
            text = e.toString()
            if _LATE in text:
                raise GuardError("a name has to be written out")
            for name in _CALL.findall(text):
                if name.replace("`", "").rpartition(".")[2].lower() not in _builtin(spark):
                    raise GuardError(f"function {name!r} isn't allowed")
        if kind == "UnresolvedWith":
            for cte in _each(node.cteRelations()):
                walk(cte._2(), known)
                known |= {cte._1().lower()}
        if kind == "UnresolvedRelation":
            name = ".".join(_each(node.multipartIdentifier()))
            if name.lower() not in known:
                found.append(name)
        for children in (node.children(), node.subqueries()):
            for child in _each(children):
                walk(child, known)

    walk(plan, frozenset())
    return found


def _each(seq: Any) -> list[Any]:
    return [seq.apply(i) for i in range(seq.size())]


class Source:
    """Views of the source by their schema-qualified names.

    Immutable: allowing() gives a wider one. Every accepted statement is told to each sink; a refused one reaches
    neither Spark nor a sink.
    """

    def __init__(self, spark: SparkSession, views: dict[str, DataFrame], *, component: str = "engine", sinks: Iterable[Callable[[AuditEvent], None]] = (), allowed: frozenset[str] | None = None):
        self.spark, self.views, self.component, self.sinks = spark, dict(views), component, tuple(sinks)
        self.allowed = frozenset(views) if allowed is None else allowed
        for name, df in self.views.items():
            df.createOrReplaceTempView(table(name))

    def allowing(self, more: Iterable[str]) -> Source:
        return Source(self.spark, self.views, component=self.component, sinks=self.sinks, allowed=self.allowed | frozenset(more))

    def check(self, sql: str) -> None:
        names = {table(v).lower() for v in self.allowed} | {v.lower() for v in self.allowed}
        for r in relations(self.spark, sql):
            if r.lower() not in names and r.split(".")[0].lower() not in METADATA:
                raise GuardError(f"relation {r!r} isn't allowed")

    def execute(self, sql: str, params: dict[str, Any] | None = None, *, run_id: str | None = None) -> DataFrame:
        """The (lazy) result of a guarded statement. The audited duration is that of analysis; Spark runs it at an action."""
        self.check(sql)
        started, at = datetime.now(timezone.utc), time.perf_counter()
        df = self.spark.sql(sql, args=params or {})
        event = AuditEvent(sql, json.dumps(params or {}, sort_keys=True, default=str), started.isoformat(), (time.perf_counter() - at) * 1000, None, self.component, run_id)
        for sink in self.sinks:
            sink(replace(event))
        return df

    def within(self, seconds: float | None, job: Callable[[], Any]) -> Any:
        """What job gives, or None if it takes longer than so many seconds; its Spark jobs are then cancelled.

        A cancelled task ends when it next looks whether it should go on; until then it keeps its core.
        """
        if seconds is None:
            return job()
        tag, late = f"plumbline-{uuid.uuid4().hex}", threading.Event()
        sc = self.spark.sparkContext

        def stop() -> None:
            late.set()
            sc.cancelJobsWithTag(tag)

        timer = threading.Timer(seconds, stop)
        sc.addJobTag(tag)
        sc.setInterruptOnCancel(True)
        timer.start()
        try:
            return job()
        except Exception:
            if late.is_set():
                return None
            raise
        finally:
            timer.cancel()
            sc.removeJobTag(tag)
            sc.setInterruptOnCancel(False)

    def flush(self) -> None:
        """Has sinks write what they hold."""
        for sink in self.sinks:
            getattr(sink, "flush", lambda: None)()

    def columns(self) -> dict[str, list[str]]:
        """Column names of each view, in order."""
        return {v: df.columns for v, df in self.views.items()}
