"""python -m plumbline COMMAND --views NAME=PATH ... [--state DIR] [--checks FILE ...] [--as-of TIME] [--run-id ID]

verify [--exported FILE]: what can be read, against a list of names; validate: check documents against the views.
profile, drafts, run, history: a catalog of the views, checks drafted from it, a run, all events.
feedback --commands FILE: reviewers' commands, JSON by line; precision, demote, recalibrate [--dry-run]: learning from them and
from the views. recalibrate --measures MODULE imports what registers measures. Jobs sent again under a --run-id happen once.

review --do list|add|show|approve|reject|amend [--slug ID] [--checks FILE] [--note TEXT] [--reviewer NAME]: the gate that checks
pass; approvals run the check on the views. run without --checks runs the checks that are active there.
"""

from __future__ import annotations

import argparse
import importlib
import json
import uuid
from datetime import datetime
from pathlib import Path

import yaml
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from plumbline.operators import drafts, feedback, jobs
from plumbline.operators.review import Gate, Reviews
from plumbline.operators.run import history, run
from plumbline.plans.document import from_dict, parse, validate
from plumbline.sources import catalog
from plumbline.sources.guard import JsonlSink, Source
from plumbline.sources.state import Store


JOBS = ("precision", "demote", "recalibrate")


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="plumbline", description=__doc__)
    p.add_argument("command", choices=("verify", "validate", "profile", "run", "drafts", "history", "review", "feedback", *JOBS))
    p.add_argument("--do", choices=("list", "add", "show", "approve", "reject", "amend"), default="list", help="what review does")
    p.add_argument("--slug", default=None, help="the check under review")
    p.add_argument("--status", default=None, help="review --do list: only checks of this status")
    p.add_argument("--note", default=None, help="a note or reason of a review")
    p.add_argument("--reviewer", default=None)
    p.add_argument("--views", nargs="*", default=[], metavar="NAME=PATH", help="Parquet tables by schema-qualified names")
    p.add_argument("--checks", nargs="*", default=[], metavar="FILE", help="check documents")
    p.add_argument("--state", default="state", help="folder of state tables and catalogs")
    p.add_argument("--as-of", type=datetime.fromisoformat, required=False, help="the time that now stands for")
    p.add_argument("--run-id", default=None, help="the id of a run or job; sent again, it changes nothing")
    p.add_argument("--exported", default=None, metavar="FILE", help="verify: names that should be there, one a line")
    p.add_argument("--commands", default=None, metavar="FILE", help="feedback: check_id, dedupe_key, command, reason_code, actor, note, until, occurred_at")
    p.add_argument("--measures", nargs="*", default=[], metavar="MODULE", help="recalibrate: modules that register measures")
    p.add_argument("--timeout", type=float, default=None, help="verify: seconds to count a view")
    p.add_argument("--dry-run", action="store_true", help="demote, recalibrate: show, and keep nothing")
    a = p.parse_args(argv)
    spark = SparkSession.builder.appName("plumbline").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    as_of = a.as_of or datetime.now()
    views = {name: spark.read.parquet(path) for name, path in (v.split("=", 1) for v in a.views)}
    store = Store(spark, a.state)
    if a.command == "history":
        history(store).orderBy("occurred_at", "check_id").show(1000, truncate=False)
    elif a.command == "profile":
        found = drafts.catalog(spark, views, as_of=as_of)
        n, digest = catalog.write(a.state, found)
        Path(a.state, f"catalog-v{n}.md").write_text(catalog.report(found), encoding="utf-8")
        print(f"catalog v{n} {digest}")
    elif a.command == "drafts":
        for d in drafts.generate(catalog.read(a.state), as_of=as_of):
            print(json.dumps(d))
    elif a.command in ("verify", "validate"):
        return _verify(a, Source(spark, views, component=a.command))
    elif a.command in ("feedback", *JOBS):
        return _job(a, Source(spark, views, component=a.command), store, as_of)
    elif a.command == "review":
        return _review(a, Source(spark, views, component="review"), store, as_of)
    else:
        source = Source(spark, views, component="run", sinks=[JsonlSink(str(Path(a.state, "audit.jsonl")))])
        Path(a.state).mkdir(parents=True, exist_ok=True)
        chosen = [parse(Path(f).read_text(encoding="utf-8")) for f in a.checks] or Reviews(source, store, as_of).active()
        for c in chosen:
            validate(spark, c, source.columns())
        print(run(source, store, chosen, run_id=a.run_id or as_of.strftime("run-%Y%m%d-%H%M%S"), as_of=as_of).markdown())
    return 0


def _verify(a: argparse.Namespace, source: Source) -> int:
    if a.command == "validate":
        checks = [parse(Path(f).read_text(encoding="utf-8")) for f in a.checks]
        wrong = jobs.problems(source, checks)
        for c in checks:
            print(f"{c.id}: {wrong.get(c.id, 'valid')}")
        return 1 if wrong else 0
    exported = Path(a.exported).read_text(encoding="utf-8").split() if a.exported else None
    found = jobs.verification(source, exported, a.timeout)
    Path(a.state).mkdir(parents=True, exist_ok=True)
    Path(a.state, "verification.json").write_text(json.dumps(found, indent=2), encoding="utf-8")
    Path(a.state, "verification.md").write_text(jobs.verification_report(found), encoding="utf-8")
    print(jobs.verification_report(found))
    return 0 if found["ok"] else 1


def _job(a: argparse.Namespace, source: Source, store: Store, as_of: datetime) -> int:
    """Prints a row of each pair, parameter or event that the job is about: practices and checks, or a batch of commands."""
    spark, batch = source.spark, a.run_id or f"{a.command}-{uuid.uuid4().hex}"
    if a.command == "feedback":
        try:
            done = jobs.review(store, spark.read.schema(feedback.COMMANDS).json(a.commands).drop("run_id"), batch)
        except feedback.FeedbackError as e:
            print(e)
            return 1
    elif a.command == "precision":
        done = jobs.precision(store, batch, as_of)
    elif a.command == "demote":
        done = jobs.demote(store, batch, as_of, dry_run=a.dry_run)
    else:
        for name in a.measures:
            importlib.import_module(name)
        checks = [parse(Path(f).read_text(encoding="utf-8")) for f in a.checks] or Reviews(source, store, as_of).active()
        done = jobs.recalibrate(store, source.views, checks, batch, dry_run=a.dry_run)
    for r in done.orderBy(*done.columns[:3]).toLocalIterator():
        print(json.dumps(r.asDict(), default=str))
    return 0


def _review(a: argparse.Namespace, source: Source, store: Store, as_of: datetime) -> int:
    gate = Reviews(source, store, as_of)
    if a.do == "list":
        for r in gate.now().where(F.lit(a.status is None) | (F.col("status") == F.lit(a.status))).orderBy("slug").collect():
            print(f"{r['slug']}\t{r['status']}\tv{r['version']}")
        return 0
    if a.do == "show":
        found = gate.now().where(F.col("slug") == a.slug).first()
        if found is None:
            print(f"{a.slug}: unknown")
            return 1
        doc = json.loads(found["document"])
        dry = Gate(source, as_of)
        dry.add(doc)
        print(f"{a.slug}  {found['status']}  v{found['version']}\n{json.dumps(doc, indent=2, sort_keys=True)}\ndry run: {dry.dry_run(a.slug)}")
        return 0
    docs = [yaml.safe_load(Path(f).read_text(encoding="utf-8")) for f in a.checks]
    asked = [{"slug": from_dict(d).id, "document": d} for d in docs] if a.do in ("add", "amend") else [{"slug": a.slug}]
    done = gate.submit(uuid.uuid4().hex, [c | {"command": a.do, "note": a.note, "actor": a.reviewer} for c in asked])
    for e in done:
        print(f"{e['slug']}: {e['command']}: {e['outcome']}, {e['status']} v{e['version']}")
    return 0 if all(e["outcome"] == "done" for e in done) else 1


if __name__ == "__main__":
    raise SystemExit(main())
