"""Narratives of many findings: a template is asked for once a group, kept, and judged on every finding it is used for.

A group is a version of a check and a shape of evidence. Templates live in a state table; only groups that aren't in it
are asked for, so a second run asks for none. Whatever comes from a model is parsed, tried on a finding of the group and
given one chance of repair; a group that stays without a template is remembered too, so it isn't asked for again and
again. Findings meet their templates in one join; rendering and judging are column expressions.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Mapping
from typing import Any, Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators import narrate
from plumbline.plans.document import Check, CheckError, from_dict, validate
from plumbline.sources.state import Store

TEMPLATES = "check_version string, shape string, template string, selected array<string>, status string, error string, prompt_hash string, asked int"
#: What a composed finding needs; evidence and params as maps of values as narrate.shown writes them.
FINDINGS = "check_version string, shape string, evidence map<string,string>, params map<string,string>"


class Client(Protocol):
    """What answers prompts: a model, a person, a recording."""

    def complete(self, prompt: str) -> str: ...


def context(check: Check, evidence: Mapping[str, str], params: Mapping[str, str], shape: str, mode: str) -> dict[str, Any]:
    """What a template may be written from. names_only: no value of any finding leaves the house."""
    out: dict[str, Any] = {"title": check.title, "category": check.category, "resolution": check.resolution, "evidence": sorted(check.evidence), "types": shape, "parameters": sorted(params), "actions": sorted(check.actions)}
    return out | ({"values": dict(evidence) | dict(params)} if mode == "off" else {})


def prompt(given: dict[str, Any], wrong: list[tuple[str, str]] | None = None, before: str | None = None) -> str:
    ask = 'Answer with JSON {"template": "...", "actions": [...]}. Name values as {{field}}; write no number, date or code yourself.'
    repair = f"\nYour answer was {json.dumps(before)}\nIt was refused: {json.dumps(wrong)}" if wrong is not None else ""
    return f"{ask}\n{json.dumps(given, sort_keys=True)}{repair}"


def parsed(answer: str) -> tuple[str, list[str]]:
    """Template and actions of an answer, a fence of code around it taken off."""
    text = answer.strip()
    if text.startswith("```"):
        text = text.partition("\n")[2].rpartition("```")[0]
    found = json.loads(text)
    template, actions = found["template"], found.get("actions", [])
    if not isinstance(template, str) or not isinstance(actions, list):
        raise ValueError("an answer has a template and a list of actions")
    return template, [str(a) for a in actions]


def wrong_with(template: str, actions: list[str], check: Check, evidence: Mapping[str, str], params: Mapping[str, str], vocabulary: list[str]) -> list[tuple[str, str]]:
    """What narrate.validate says of the template's own rendering over one finding."""
    try:
        text = narrate.render(template, evidence, params)[0]
    except narrate.UnknownPlaceholder:
        text = ""
    return narrate.validate(template, text, evidence=evidence, params=params, declared=check.evidence, actions=check.actions, selected=actions, vocabulary=vocabulary)


def _ask(client: Client, check: Check, row: Any, mode: str, vocabulary: list[str], record: Callable[[str, str], None] | None) -> tuple:
    """A row of TEMPLATES: at most two questions."""
    given, wrong, before = context(check, row["evidence"], row["params"], row["shape"], mode), None, None
    for asked in (1, 2):
        question = prompt(given, wrong, before)
        digest = hashlib.sha256(question.encode()).hexdigest()
        try:
            before = client.complete(question)
            if record:
                record(question, before)
            template, actions = parsed(before)
        except Exception as e:  # noqa: BLE001  whatever a model does, the finding gets its fallback
            wrong, status = [("no_template", f"{type(e).__name__}: {e}")], "fallback_static"
            continue
        wrong, status = wrong_with(template, actions, check, row["evidence"], row["params"], vocabulary), "blocked_fallback"
        if not wrong:
            return (row["check_version"], row["shape"], template, actions, "valid", None, digest, asked)
    return (row["check_version"], row["shape"], None, [], status, json.dumps(wrong), digest, asked)


def templates(findings: DataFrame, checks: Mapping[str, Check], client: Client | None, store: Store, *, mode: str | None = None, vocabulary: list[str] = (), record: Callable[[str, str], None] | None = None) -> int:
    """Asks for the templates of the findings' groups that aren't kept yet, keeps them, and gives how many groups were new.

    checks: by check_version. What comes to the driver is a finding of each new group - versions times shapes, not findings.
    Without a client, new groups get the fallback and are not remembered. Calls that overlap both keep what they have asked.
    """
    spark, mode = findings.sparkSession, narrate.redaction_mode(mode)
    known = store.read("templates", TEMPLATES).select("check_version", "shape")
    new = findings.join(known, ["check_version", "shape"], "left_anti")
    rows = new.groupBy("check_version", "shape").agg(F.min_by(F.struct("evidence", "params"), F.to_json(F.map_entries("evidence"))).alias("one")).select("check_version", "shape", "one.*")
    asked = sorted((r for r in rows.collect() if r["check_version"] in checks), key=lambda r: (r["check_version"], r["shape"]))
    if not asked or client is None:
        return 0
    made = spark.createDataFrame([_ask(client, checks[r["check_version"]], r, mode, list(vocabulary), record) for r in asked], TEMPLATES)
    while True:
        base = store.version("templates")
        kept = store.read("templates", TEMPLATES, base)
        if store.write("templates", kept.unionByName(made.join(kept, ["check_version", "shape"], "left_anti")), base=base):
            return len(asked)


def composed(findings: DataFrame, checks: Mapping[str, Check], kept: DataFrame, fallback: str, *, vocabulary: list[str] = ()) -> DataFrame:
    """findings with template, text, selected, narrative_status and violations, all of it as column expressions.

    A kept template is judged on each finding's own values. narrative_status: valid; blocked_fallback: the template didn't
    hold for this finding; fallback_static: there is none. Both of these show the fallback, fields it can't fill as None.
    """
    spark = findings.sparkSession
    facts = F.broadcast(spark.createDataFrame([(v, list(c.evidence), list(c.actions)) for v, c in checks.items()], "check_version string, declared array<string>, actions array<string>"))
    rows = findings.join(F.broadcast(kept.select("check_version", "shape", "template", "selected", F.col("status").alias("kept_status"))), ["check_version", "shape"], "left").join(facts, "check_version", "left")
    none = F.array().cast("array<string>")
    rows = rows.withColumns({"selected": F.coalesce("selected", none), "declared": F.coalesce("declared", none), "actions": F.coalesce("actions", none), "vocabulary": F.array(*map(F.lit, vocabulary)).cast("array<string>")})
    rows = narrate.with_rendering(rows, "template", "text")
    judged = narrate.violations(rows)
    good = F.col("template").isNotNull() & (F.size("violations") == 0)
    status = F.when(good, "valid").when(F.col("template").isNotNull(), "blocked_fallback").otherwise(F.coalesce("kept_status", F.lit("fallback_static")))
    judged = judged.withColumn("narrative_status", status).withColumn("template", F.when(good, F.col("template")).otherwise(F.lit(fallback)))
    judged = narrate.with_rendering(judged, "template", "_fallback").withColumns({"text": F.when(good, F.col("text")).otherwise(F.col("_fallback")), "selected": F.when(good, F.col("selected")).otherwise(none)})
    return judged.select(*findings.columns, "template", "text", "selected", "narrative_status", F.coalesce("violations", F.expr("CAST(array() AS array<struct<rule:string,detail:string>>)")).alias("violations"))


def drafted(client: Client, spark: Any, brief: str, columns: dict[str, list[str]]) -> tuple[list[Check], list[tuple[Any, str]]]:
    """Checks of a model's answer (a JSON list of documents): each wrong one is sent back once with what is wrong.

    What is still wrong then is given with its error.
    """

    def listed(answer: str) -> list[Any]:
        text = answer.strip()
        if text.startswith("```"):
            text = text.partition("\n")[2].rpartition("```")[0]
        found = json.loads(text)
        return found if isinstance(found, list) else [found]

    def made(doc: Any) -> Check | str:
        try:
            check = from_dict(doc)
            validate(spark, check, columns)
            return check
        except CheckError as e:
            return str(e)

    good, bad = [], []
    for doc in listed(client.complete(brief)):
        check = made(doc)
        if isinstance(check, str):
            error = check
            try:
                doc = listed(client.complete(f"{brief}\nThis document was refused: {json.dumps(doc)}\n{error}"))[0]
                check = made(doc)
            except (json.JSONDecodeError, IndexError, TypeError) as e:
                check = f"{error}; no repair: {e}"
        if isinstance(check, str):
            bad.append((doc, check))
        else:
            good.append(check)
    return good, bad
