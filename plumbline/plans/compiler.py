"""Check documents to Spark SQL: one deterministic statement a check, and one statement for many checks of a view.

Each row is judged once: prerequisites and predicate are columns of an inner select, so an EXISTS clause is one
existence join although the outcome looks at the predicate twice.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass
from typing import Any

from plumbline.plans.document import Check, CheckError, Exists, Node
from plumbline.plans.leaf import spark_sql

OUTCOME = "CASE WHEN __ready THEN CASE WHEN __failed THEN 'fail' WHEN NOT __failed THEN 'pass' ELSE 'indeterminate' END ELSE 'indeterminate' END"


@dataclass(frozen=True)
class Compiled:
    check: Check
    sql: str
    sql_hash: str
    #: Parameter name to its type; arrays appear as their elements name_0, name_1, ...
    params: dict[str, str]


def table(view: str) -> str:
    """Name under which a view is registered."""
    return view.replace(".", "__")


def arrays(check: Check) -> dict[str, int]:
    """Number of elements of each array parameter; these are fixed and not empty."""
    found = {}
    for name, p in check.params.items():
        if p.type == "array":
            if p.strategy != "fixed" or not isinstance(p.value, list) or not p.value:
                raise CheckError(f"array parameter {name!r} needs a fixed, non-empty default")
            found[name] = len(p.value)
    return found


def params_of(check: Check) -> dict[str, str]:
    sizes, out = arrays(check), {}
    for name, p in check.params.items():
        if name in sizes:
            kinds = {"boolean" if isinstance(v, bool) else "integer" if isinstance(v, int) else "number" if isinstance(v, float) else "string" for v in p.value}
            out |= {f"{name}_{i}": kinds.pop() if len(kinds) == 1 else "string" for i in range(sizes[name])}
        else:
            out[name] = p.type
    return out


def condition(node: Any, check: Check) -> str:
    """A predicate tree as one three-valued SQL condition."""
    text = lambda leaf: spark_sql(leaf, check.views, arrays(check))
    if isinstance(node, str):
        return f"({text(node)})"
    if isinstance(node, Exists):
        where = f" AND ({text(node.where)})" if node.where else ""
        return f"{'NOT ' if node.negated else ''}EXISTS (SELECT 1 FROM {table(node.view)} AS `{node.view}` WHERE ({text(node.on)}){where})"
    assert isinstance(node, Node)
    if node.kind == "not":
        return f"(NOT {condition(node.children[0], check)})"
    return "(" + {"all": " AND ", "any": " OR "}[node.kind].join(condition(c, check) for c in node.children) + ")"


#: How many rows share some columns, counted over all rows that are read.
_SHARED = re.compile(r"\bCOUNT\s*\(\s*\*\s*\)\s+OVER\s*\(\s*PARTITION\s+BY\s+([^()]+?)\s*\)", re.IGNORECASE)


def _counted(sql: str, check: Check, where: list[str], joins: dict[str, tuple[str, str]]) -> str:
    """A condition whose counts over partitions are looked up: keys of several rows are counted first, and only these join.

    Counts combine before the shuffle, and a key has one row on the joined side, so a key of very many rows doesn't meet
    in one task. joins gets each subquery with its alias and condition. A partition with an order stays a window.
    """

    def looked_up(m: re.Match) -> str:
        if re.search(r"\bORDER\s+BY\b", m[1], re.IGNORECASE):
            return m[0]
        keys = [k.strip() for k in m[1].split(",")]
        named = ", ".join(f"{k} AS __k{i}" for i, k in enumerate(keys))
        kept = f" WHERE {' AND '.join(where)}" if where else ""
        inner = f"SELECT {named}, COUNT(*) AS __n FROM {table(check.view)} AS `{check.view}`{kept} GROUP BY {', '.join(keys)} HAVING COUNT(*) > 1"
        alias = next((a for a, (i, _) in joins.items() if i == inner), f"__d{len(joins)}")
        joins[alias] = (inner, " AND ".join(f"{k} <=> {alias}.__k{i}" for i, k in enumerate(keys)))
        return f"coalesce({alias}.__n, 1)"

    return _SHARED.sub(looked_up, sql)


def _joined(joins: dict[str, tuple[str, str]]) -> str:
    return "".join(f" LEFT JOIN ({inner}) AS {alias} ON {on}" for alias, (inner, on) in joins.items())


def _ready(check: Check) -> str:
    return " AND ".join(f"({spark_sql(p, check.views, arrays(check))})" for p in check.prerequisites) or "1 = 1"


def _kept(check: Check, watermark: str | None, practice: bool) -> list[str]:
    filters = [f"({spark_sql(f, check.views, arrays(check))})" for f in check.base_filters]
    if watermark:
        filters += [f"(:wm_from IS NULL OR `{watermark}` > CAST(:wm_from AS TIMESTAMP_NTZ))", f"(`{watermark}` <= CAST(:wm_to AS TIMESTAMP_NTZ))"]
    if practice:
        filters.append(f"(`{check.practice_column}` = :practice_id)")
    return filters


def projected(check: Check) -> tuple[list[str], list[str]]:
    """Columns before and after the outcome: key and practice, then evidence not among them; each once, in author order."""
    head = list(dict.fromkeys([*check.key, check.practice_column]))
    return head, [c for c in dict.fromkeys(check.evidence) if c not in head]


def compile_check(check: Check, *, watermark: str | None = None, practice_scope: bool = False, full_partition: bool = False) -> Compiled:
    """The statement that judges each row of a check's view.

    watermark: a time column; rows outside (:wm_from, :wm_to] are left out. practice_scope: only :practice_id's rows.
    full_partition: rows that share columns are counted over the whole view, not only over the rows that are judged.
    """
    head, tail = projected(check)
    filters = _kept(check, watermark, practice_scope)
    where = "\n  WHERE " + "\n    AND ".join(filters) if filters else ""
    names = ", ".join(f"`{c}`" for c in head)
    rest = "".join(f", `{c}`" for c in tail)
    inner = "".join(f"`{check.view}`.`{c}`, " for c in (*head, *tail))
    joins: dict[str, tuple[str, str]] = {}
    counted_over = _kept(check, None, False) if full_partition else filters
    ready, failed = (_counted(x, check, counted_over, joins) for x in (_ready(check), condition(check.predicate, check)))
    sql = f"SELECT {names}, {OUTCOME} AS tri_state{rest}\nFROM (\n  SELECT {inner}({ready}) AS __ready, {failed} AS __failed\n  FROM {table(check.view)} AS `{check.view}`{_joined(joins)}{where}\n)"
    return Compiled(check, sql, hashlib.sha256(sql.encode()).hexdigest(), params_of(check))


def compile_fused(checks: list[Check], *, watermark: str | None = None, slim: bool = False, full_partition: bool = False, condition_sql: str | None = None) -> str:
    """One statement for checks of one view: a row for each check and row that its base filters keep.

    The view is scanned once, and rows that no check's base filters keep are left out by the scan. Equal EXISTS clauses
    are computed once, as are equal base filters. Columns: check_id, practice_id, entity_key (canonical JSON), tri_state,
    evidence (JSON); slim: without key and evidence, for tallies. Parameters are named <number of the check>__<name>.
    full_partition as in compile_check. condition_sql: of the view's rows only those are judged.
    """
    view = checks[0].view
    if any(c.view != view for c in checks):
        raise CheckError("fused checks share their view")
    clauses: dict[str, str] = {}
    joins: dict[str, tuple[str, str]] = {}
    parts, filters = [], []
    for n, check in enumerate(checks):
        head, tail = projected(check)

        def own(sql: str, n: int = n) -> str:
            for p in sorted(params_of(checks[n]), key=len, reverse=True):
                sql = sql.replace(f":{p}", f":{n}__{p}") if f":{n}__{p}" not in sql else sql
            return sql

        def name(sql: str) -> str:
            return clauses.setdefault(sql, f"__c{len(clauses)}")

        filters.append(own(" AND ".join(_kept(check, None, False))))
        counted_over = [own(f) for f in _kept(check, None if full_partition else watermark, False)]
        ready, failed = (name(_counted(own(s), check, counted_over, joins)) for s in (_ready(check), condition(check.predicate, check)))
        kept = name(filters[-1]) if filters[-1] and len(checks) > 1 else None
        key = ", ".join(f"'{c}', `{c}`" for c in sorted(check.key))
        evidence = ", ".join(f"'{c}', `{c}`" for c in (*head, *tail))
        outcome = OUTCOME.replace("__ready", ready).replace("__failed", failed)
        fields = {"check_id": f"'{check.id}'", "practice_id": f"CAST(`{check.practice_column}` AS STRING)", "entity_key": f"to_json(named_struct({key}))", "tri_state": outcome, "evidence": f"to_json(named_struct({evidence}))"}
        row = "named_struct(" + ", ".join(f"'{f}', {sql}" for f, sql in fields.items() if not (slim and f in ("entity_key", "evidence"))) + ")"
        parts.append(f"IF({kept}, {row}, NULL)" if kept else row)
    columns = ", ".join(f"`{view}`.`{c}`" for c in dict.fromkeys(x for check in checks for y in projected(check) for x in y))
    scans = _kept(checks[0], watermark, False)[len(checks[0].base_filters) :] + ([condition_sql] if condition_sql else [])
    if all(filters):
        scans.append("(" + " OR ".join(dict.fromkeys(f"({f})" for f in filters)) + ")")
    scan = " AND ".join(scans)
    shown = ", ".join(f"({sql}) AS {alias}" for sql, alias in clauses.items())
    inner = f"SELECT {columns}, {shown} FROM {table(view)} AS `{view}`{_joined(joins)}" + (f" WHERE {scan}" if scan else "")
    return f"SELECT inline(filter(array({', '.join(parts)}), x -> x IS NOT NULL)) FROM ({inner})"
