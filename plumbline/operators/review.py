"""The gate that drafts pass: listing, dry runs, approval, rejection and amendment."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, replace
from datetime import datetime
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.operators.execute import execute
from plumbline.plans.document import Check, CheckError, can_be_indeterminate, from_dict, validate
from plumbline.sources.guard import Source
from plumbline.sources.state import Store

REVIEWS = "slug string, status string, version int, document string"
COMMANDS = "slug string, nth int, command string, document string, note string, actor string, passes boolean, occurred_at timestamp_ntz"
EVENTS = "slug string, nth int, command string, outcome string, status string, version int, document string, note string, actor string, occurred_at timestamp_ntz"


@dataclass(frozen=True)
class Entry:
    """A check under review, with its versions (documents) from the first on."""

    slug: str
    status: str
    versions: tuple[dict[str, Any], ...]
    notes: tuple[str, ...] = ()

    @property
    def check(self) -> Check:
        return from_dict(self.versions[-1])


@dataclass
class Gate:
    """Checks under review. Approval needs a dry run on fixture views that shows each outcome the check can have."""

    source: Source
    as_of: datetime
    entries: dict[str, Entry] = field(default_factory=dict)

    def add(self, doc: dict[str, Any]) -> bool:
        """False if the slug is known."""
        check = from_dict(doc)
        if check.id in self.entries:
            return False
        self.entries[check.id] = Entry(check.id, "draft", (doc,))
        return True

    def list(self, status: str | None = None) -> list[Entry]:
        return [e for _, e in sorted(self.entries.items()) if status in (None, e.status)]

    def dry_run(self, slug: str) -> dict[str, int]:
        rows = execute(self.source, self.entries[slug].check, as_of=self.as_of).groupBy("tri_state").count().collect()
        return {"fail": 0, "pass": 0, "indeterminate": 0} | {r["tri_state"]: r["count"] for r in rows}

    def passes(self, slug: str) -> bool:
        """At least one fail and one pass, and one indeterminate row if the check can have one."""
        n = self.dry_run(slug)
        return n["fail"] > 0 and n["pass"] > 0 and (n["indeterminate"] > 0 or not can_be_indeterminate(self.entries[slug].check))

    def approve(self, slug: str, note: str = "") -> None:
        validate(self.source.spark, self.entries[slug].check, self.source.columns())
        if not self.passes(slug):
            raise CheckError(f"{slug}: the dry run doesn't show every outcome: {self.dry_run(slug)}")
        self._move(slug, "active", note)

    def reject(self, slug: str, note: str) -> None:
        self._move(slug, "rejected", note)

    def amend(self, slug: str, doc: dict[str, Any], note: str) -> None:
        """A new version under the same slug; it is a draft again. Its views follow from the document."""
        if from_dict(doc).id != slug:
            raise CheckError(f"an amendment keeps the id {slug!r}")
        e = self.entries[slug]
        self.entries[slug] = replace(e, status="draft", versions=(*e.versions, doc), notes=(*e.notes, note))

    def _move(self, slug: str, status: str, note: str) -> None:
        e = self.entries[slug]
        self.entries[slug] = replace(e, status=status, notes=(*e.notes, note))


def applied(commands: DataFrame, reviews: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(reviews, events) after commands, each check's in their order; one fold a check, all checks at once.

        command   asks for                                  then
        add       an unknown slug                           draft, version 1
        approve   a draft whose dry run passes              active
        reject    a draft and a reason                      rejected
        amend     a known slug and a note                   draft, the next version

    Every command gives an event; of a refused one, outcome says why, and nothing changes.
    """
    row = "struct<nth:int,command:string,outcome:string,status:string,version:int,document:string,note:string,actor:string,occurred_at:timestamp_ntz>"
    order = F.array_sort(F.collect_list(F.struct("nth", "occurred_at", "command", "document", "note", "actor", "passes")))
    each = commands.groupBy("slug").agg(order.alias("commands")).join(reviews, "slug", "left")
    start = F.struct(F.col("status").alias("status"), F.coalesce("version", F.lit(0)).alias("version"), F.col("document").alias("document"), F.expr(f"CAST(array() AS array<{row}>)").alias("events"))

    def step(a: Column, x: Column) -> Column:
        known, draft, said = a["status"].isNotNull(), F.coalesce(a["status"] == "draft", F.lit(False)), F.coalesce(F.trim(x["note"]) != "", F.lit(False))
        c = x["command"]
        outcome = (
            F.when(~c.isin("add", "approve", "reject", "amend"), "unknown_command")
            .when((c == "add") & known, "known_already")
            .when((c != "add") & ~known, "unknown_check")
            .when(c.isin("reject", "amend") & ~said, "note_missing")
            .when(c.isin("approve", "reject") & ~draft, "not_a_draft")
            .when((c == "approve") & ~F.coalesce(x["passes"], F.lit(False)), "dry_run_failed")
            .when(c.isin("add", "amend") & x["document"].isNull(), "document_missing")
            .otherwise("done")
        )
        done, new = outcome == "done", c.isin("add", "amend")
        status = F.when(done, F.when(new, "draft").when(c == "approve", "active").otherwise("rejected")).otherwise(a["status"])
        version = a["version"] + F.when(done & new, 1).otherwise(0)
        document = F.when(done & new, x["document"]).otherwise(a["document"])
        event = F.struct(x["nth"].alias("nth"), c.alias("command"), outcome.alias("outcome"), status.alias("status"), version.alias("version"), F.when(done & new, x["document"]).alias("document"), x["note"].alias("note"), x["actor"].alias("actor"), x["occurred_at"].alias("occurred_at"))
        return F.struct(status.alias("status"), version.alias("version"), document.alias("document"), F.concat(a["events"], F.array(event)).alias("events"))

    folded = each.select("slug", F.aggregate("commands", start, step).alias("r"))
    after = folded.where("r.status IS NOT NULL").select("slug", "r.status", "r.version", "r.document")
    events = folded.select("slug", F.inline("r.events"))
    return reviews.join(after.select("slug"), "slug", "left_anti").unionByName(after), events


class Reviews:
    """The gate over a state store: reviews as versioned snapshots, and a log of all commands with their outcomes."""

    def __init__(self, source: Source, store: Store, as_of: datetime):
        self.source, self.store, self.as_of = source, store, as_of

    def now(self) -> DataFrame:
        return self.store.read("reviews", REVIEWS)

    def history(self) -> DataFrame:
        return self.store.log("review_events", EVENTS)

    def submit(self, batch_id: str, commands: list[dict[str, Any]]) -> list[dict[str, Any]]:
        """Applies commands {slug, command, document, note, actor} once, however often the batch is sent; gives their events.

        An approval runs the check on the source's views. Batches that overlap land one behind the other.
        """
        spark, store = self.source.spark, self.store
        while not any(v.by == batch_id for v in store.versions("reviews")):
            base = store.version("reviews")
            before = store.read("reviews", REVIEWS, base)
            asked = sorted({c["slug"] for c in commands})
            documents = {r["slug"]: r["document"] for r in before.where(F.col("slug").isin(asked)).collect()}  # of this batch's checks
            rows = []
            for n, c in enumerate(commands):
                text = json.dumps(c["document"], sort_keys=True) if c.get("document") else None
                if c["command"] == "amend" and text and from_dict(c["document"]).id != c["slug"]:
                    raise CheckError(f"an amendment keeps the id {c['slug']!r}")
                if c["command"] == "amend" or c["command"] == "add" and c["slug"] not in documents:
                    documents[c["slug"]] = text
                known = documents.get(c["slug"])
                rows.append((c["slug"], n, c["command"], text, c.get("note"), c.get("actor"), bool(known) and c["command"] == "approve" and self._passes(json.loads(known)), self.as_of))
            after, events = applied(spark.createDataFrame(rows, COMMANDS), before)
            store.append("review_events", events, batch_id)
            store.write("reviews", after, base=base, by=batch_id)
        return [r.asDict() for r in store.part("review_events", EVENTS, batch_id).orderBy("nth").collect()]

    def _passes(self, doc: dict[str, Any]) -> bool:
        gate = Gate(self.source, self.as_of)
        try:
            gate.add(doc)
            slug = next(iter(gate.entries))
            validate(self.source.spark, gate.entries[slug].check, self.source.columns())
            return gate.passes(slug)
        except CheckError:
            return False

    def active(self) -> list[Check]:
        """The checks that runs may use."""
        return [from_dict(json.loads(r["document"])) for r in self.now().where("status = 'active'").orderBy("slug").collect()]
