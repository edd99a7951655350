"""Check documents: what a check says, and whether it says it well.

A check names an entity (a view, its key, its practice column and base filters), typed parameters, prerequisites, a
predicate tree over opaque SQL leaves, evidence columns, actions and a resolution.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from typing import Any

import yaml

from plumbline.plans import leaf

CATEGORIES = ("referential", "data-quality", "workflow", "care-gap", "revenue-integrity", "policy")
SEVERITIES = ("low", "medium", "high", "critical")
PARAM_TYPES = ("integer", "number", "string", "boolean", "array")
VIEW_NAME = re.compile(r"[A-Za-z_]\w*\.[A-Za-z_]\w*\Z", re.ASCII)
SLUG = re.compile(r"[a-z][a-z0-9]*(-[a-z0-9]+)*\Z")

#: The curated actions (code, title, description).
ACTIONS = (
    ("book-recall", "Book a recall", "Schedule a follow-up appointment for the patient."),
    ("verify-invoice", "Verify invoice", "Check the invoice against the source record and correct it if needed."),
    ("chase-result", "Chase a result", "Follow up on an ordered test or result that has not come back."),
    ("flag-for-clinician-review", "Flag for clinician review", "Route the finding to a clinician for judgment; no automated action taken."),
    ("correct-record", "Correct record", "Fix a data-entry error in the source record."),
    ("raise-billing-task", "Raise billing task", "Create a task for the billing team to resolve a financial discrepancy."),
    ("request-nhi-lookup", "Request NHI lookup", "Ask reception/admin staff to look up and record the patient's NHI."),
    ("flag-for-data-steward-review", "Flag for data steward review", "Route a data-quality issue to whoever owns source-data stewardship."),
    ("raise-recall-task", "Raise recall task", "Create a task for staff to recall a patient who is overdue."),
)
ACTION_CODES = frozenset(a[0] for a in ACTIONS)


class CheckError(ValueError):
    """A document is malformed, or refers to something unknown; the message names it."""


@dataclass(frozen=True)
class Exists:
    """A correlated (not) exists clause."""

    view: str
    on: str
    where: str | None = None
    negated: bool = False


@dataclass(frozen=True)
class Node:
    """all, any or not over children; a child is a Node, an Exists or a leaf string."""

    kind: str
    children: tuple[Any, ...]


@dataclass(frozen=True)
class Param:
    type: str
    strategy: str
    value: Any = None
    measure: str | None = None
    p: float | None = None

    @property
    def default(self) -> Any:
        """The fixed value, or what holds until one is learned."""
        return self.value


@dataclass(frozen=True)
class Check:
    id: str
    title: str
    category: str
    severity: str
    view: str
    key: tuple[str, ...]
    practice_column: str
    base_filters: tuple[str, ...]
    params: dict[str, Param]
    prerequisites: tuple[str, ...]
    predicate: Any
    evidence: tuple[str, ...]
    actions: tuple[str, ...]
    resolution: str
    raw: dict[str, Any] = field(compare=False, repr=False, default_factory=dict)

    @property
    def views(self) -> tuple[str, ...]:
        """The driving view, then the joined ones in order of appearance."""
        found = dict.fromkeys([self.view])

        def walk(node: Any) -> None:
            if isinstance(node, Exists):
                found.setdefault(node.view)
            elif isinstance(node, Node):
                for child in node.children:
                    walk(child)

        walk(self.predicate)
        return tuple(found)


def _want(ok: bool, message: str) -> None:
    if not ok:
        raise CheckError(message)


def _text(value: Any, what: str) -> str:
    _want(isinstance(value, str) and bool(value), f"{what} must be a non-empty string")
    return value


def _texts(value: Any, what: str, least: int = 0) -> tuple[str, ...]:
    _want(isinstance(value, list) and len(value) >= least, f"{what} must be a list of at least {least} strings")
    return tuple(_text(v, f"{what}[{i}]") for i, v in enumerate(value))


def _keys(value: Any, what: str, required: set[str], optional: set[str] = frozenset()) -> dict[str, Any]:
    # YAML 1.1 reads a bare `on` as true
    value = {("on" if k is True else k): v for k, v in value.items()} if isinstance(value, dict) else value
    _want(isinstance(value, dict), f"{what} must be a mapping")
    missing, unknown = required - set(value), set(value) - required - set(optional)
    _want(not missing, f"{what}: missing {sorted(missing)}")
    _want(not unknown, f"{what}: unknown {sorted(map(str, unknown))}")
    return value


def _view(value: Any, what: str) -> str:
    _want(isinstance(value, str) and bool(VIEW_NAME.match(value)), f"{what}: {value!r} is not a schema-qualified name")
    return value


def _node(value: Any, where: str) -> Any:
    if isinstance(value, str):
        return _text(value, where)
    _want(isinstance(value, dict) and len(value) == 1, f"{where}: a predicate node is a string or a mapping with one key")
    kind, inner = next(iter(value.items()))
    if kind in ("all", "any"):
        _want(isinstance(inner, list) and bool(inner), f"{where}.{kind} must be a non-empty list")
        return Node(kind, tuple(_node(v, f"{where}.{kind}[{i}]") for i, v in enumerate(inner)))
    if kind == "not":
        return Node("not", (_node(inner, f"{where}.not"),))
    _want(kind in ("exists", "not_exists"), f"{where}: unknown predicate node {kind!r}")
    d = _keys(inner, f"{where}.{kind}", {"view", "on"}, {"where"})
    return Exists(_view(d["view"], f"{where}.{kind}.view"), _text(d["on"], f"{where}.{kind}.on"), _text(d["where"], f"{where}.{kind}.where") if "where" in d else None, kind == "not_exists")


def _param(name: str, value: Any) -> Param:
    d = _keys(value, f"params.{name}", {"type", "default"})
    _want(d["type"] in PARAM_TYPES, f"params.{name}: unknown type {d['type']!r}")
    strategy = d["default"].get("strategy") if isinstance(d["default"], dict) else None
    if strategy == "fixed":
        p = _keys(d["default"], f"params.{name}.default", {"strategy", "value"})
        return Param(d["type"], "fixed", p["value"])
    _want(strategy == "percentile", f"params.{name}: a default's strategy is fixed or percentile")
    p = _keys(d["default"], f"params.{name}.default", {"strategy", "measure", "p", "fallback"})
    _want(isinstance(p["p"], (int, float)) and 0 < p["p"] <= 100, f"params.{name}: p must lie in (0, 100]")
    return Param(d["type"], "percentile", p["fallback"], _text(p["measure"], f"params.{name}.measure"), float(p["p"]))


def from_dict(d: Any) -> Check:
    """A structurally valid check; CheckError otherwise."""
    d = _keys(d, "check", {"id", "title", "category", "default_severity", "entity", "params", "prerequisites", "predicate", "evidence", "actions", "resolution"})
    _want(isinstance(d["id"], str) and bool(SLUG.match(d["id"])), f"id: {d['id']!r} is not a kebab-case slug")
    _want(d["category"] in CATEGORIES, f"category: unknown {d['category']!r}")
    _want(d["default_severity"] in SEVERITIES, f"default_severity: unknown {d['default_severity']!r}")
    e = _keys(d["entity"], "entity", {"view", "key", "practice_column", "base_filters"})
    _want(isinstance(d["params"], dict), "params must be a mapping")
    return Check(
        d["id"],
        _text(d["title"], "title"),
        d["category"],
        d["default_severity"],
        _view(e["view"], "entity.view"),
        _texts(e["key"], "entity.key", 1),
        _text(e["practice_column"], "entity.practice_column"),
        _texts(e["base_filters"], "entity.base_filters"),
        {str(k): _param(str(k), v) for k, v in d["params"].items()},
        _texts(d["prerequisites"], "prerequisites"),
        _node(d["predicate"], "predicate"),
        _texts(d["evidence"], "evidence", 1),
        _texts(d["actions"], "actions", 1),
        _text(d["resolution"], "resolution"),
        d,
    )


def parse(text: str) -> Check:
    """A check from YAML (or JSON) text."""
    return from_dict(yaml.safe_load(text))


def validate(spark, check: Check, columns: dict[str, list[str]]) -> None:
    """Checks every reference against columns (view -> its column names); CheckError names the first that is unknown."""
    known = {v: {c.lower() for c in cs} for v, cs in columns.items()}
    for v in check.views:
        _want(v in known, f"unknown view {v!r}")

    def column(name: str, views: tuple[str, ...], what: str) -> None:
        _want(any(name.lower() in known[v] for v in views), f"{what}: unknown column {name!r}")

    def expression(text: str, views: tuple[str, ...], what: str) -> None:
        for p in leaf.params(text):
            _want(p in check.params, f"{what}: unknown parameter {p!r}")
        for view, name in leaf.columns(spark, text, check.views):
            if view is not None:
                _want(view in known, f"{what}: unknown view {view!r}")
                _want(view in views, f"{what}: view {view!r} isn't in scope")
            column(name, (view,) if view else views, what)

    own = (check.view,)
    for c in (*check.key, check.practice_column):
        column(c, own, "entity")
    for c in check.evidence:
        column(c, own, "evidence")
    for f in check.base_filters:
        expression(f, own, "base_filters")
    for f in check.prerequisites:
        expression(f, own, "prerequisites")

    def walk(node: Any) -> None:
        if isinstance(node, str):
            expression(node, own, "predicate")
        elif isinstance(node, Exists):
            _want(node.view != check.view, f"exists: {node.view!r} is the entity's own view; without an alias it asks about the whole population")
            expression(node.on, (check.view, node.view), "exists.on")
            if node.where:
                expression(node.where, (check.view, node.view), "exists.where")
        else:
            for child in node.children:
                walk(child)

    walk(check.predicate)
    for a in check.actions:
        _want(a in ACTION_CODES, f"unknown action {a!r}")


def can_be_indeterminate(check: Check) -> bool:
    """Whether some row may be indeterminate: there is a prerequisite, or a leaf outside exists, which is two-valued."""

    def three_valued(node: Any) -> bool:
        if isinstance(node, str):
            return not re.fullmatch(r"\s*[\w.\[\]`]+\s+IS\s+(NOT\s+)?NULL\s*", node, re.IGNORECASE)
        return isinstance(node, Node) and any(map(three_valued, node.children))

    return bool(check.prerequisites) or three_valued(check.predicate)


def default_params(check: Check) -> dict[str, Any]:
    """Fixed values, and fallbacks where a value is learned."""
    return {name: p.default for name, p in check.params.items()}
