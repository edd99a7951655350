"""Leaves of check documents: Spark SQL expressions, with a few T-SQL spellings rewritten.

Rewritten outside string literals: [name] to `name`, sysdatetime() / getdate() to the bound as-of time, DATEDIFF(day, a, b)
to a difference of dates, LEN(x) to the length without trailing blanks, {p} to :p, and schema.view.column so that a
dotted view is one name. All else, Spark's own parser reads.
"""

from __future__ import annotations

import re

_LITERAL = re.compile(r"('(?:[^']|'')*')")
_PARAM = re.compile(r"\{(\w+)\}")
_NOW = re.compile(r"\b(?:sysdatetime|getdate|sysutcdatetime|getutcdate)\s*\(\s*\)", re.IGNORECASE)
NOW = "CAST(:as_of AS TIMESTAMP_NTZ)"


def params(text: str) -> list[str]:
    """Names of the parameters that a leaf refers to, in order."""
    return [m for part in _LITERAL.split(text)[::2] for m in _PARAM.findall(part)]


def _call(text: str, name: str, arity: int, rewrite) -> str:
    """Rewrites each call name(a, b, ...) of so many arguments."""
    pattern, at = re.compile(rf"\b{name}\s*\(", re.IGNORECASE), 0
    while m := pattern.search(text, at):
        depth, quoted, cuts = 1, False, [m.end()]
        for i in range(m.end(), len(text)):
            c = text[i]
            if c == "'":
                quoted = not quoted
            elif not quoted:
                depth += (c == "(") - (c == ")")
                if c == "," and depth == 1:
                    cuts.append(i + 1)
                if depth == 0:
                    break
        else:
            raise ValueError(f"unbalanced parentheses in {text!r}")
        args = [text[x:y].strip() for x, y in zip(cuts, [*(c - 1 for c in cuts[1:]), i])]
        new = rewrite(args) if len(args) == arity else None
        if new is None:
            at = m.end()
        else:
            text = text[: m.start()] + new + text[i + 1 :]
            at = m.start() + (len(new) if name.lower() in new.lower() else 0)
    return text


def _datediff(args: list[str]) -> str | None:
    return f"date_diff(to_date({args[2]}), to_date({args[1]}))" if args[0].lower() in ("day", "dd", "d") else None


def spark_sql(text: str, views: tuple[str, ...] = (), arrays: dict[str, int] | None = None) -> str:
    """A leaf in Spark SQL with :name markers; arrays: number of elements of each array parameter."""

    def marker(m: re.Match) -> str:
        n = (arrays or {}).get(m[1])
        return f":{m[1]}" if n is None else ", ".join(f":{m[1]}_{i}" for i in range(n))

    parts = _LITERAL.split(text)
    for i in range(0, len(parts), 2):
        part = _PARAM.sub(marker, parts[i])
        part = re.sub(r"\[([^\]]+)\]", r"`\1`", part)
        part = _NOW.sub(NOW, part)
        for v in sorted(views, key=len, reverse=True):
            part = re.sub(rf"(?<![\w.`]){re.escape(v)}\.(?=[\w`])", f"`{v}`.", part)
        parts[i] = part
    text = _call("".join(parts), "DATEDIFF", 3, _datediff)
    return _call(text, "LEN", 1, lambda a: f"length(rtrim({a[0]}))")


def columns(spark, text: str, views: tuple[str, ...] = ()) -> list[tuple[str | None, str]]:
    """(view or None, column) of each column that a leaf refers to, as Spark's parser reads it."""
    ready = re.sub(r":(\w+)", "NULL", _PARAM.sub("NULL", spark_sql(_PARAM.sub("NULL", text), views)))
    tree = spark._jsparkSession.sessionState().sqlParser().parseExpression(ready)
    found, names = [], tree.collectLeaves()
    for i in range(names.size()):
        node = names.apply(i)
        if node.getClass().getSimpleName() == "UnresolvedAttribute":
            parts = node.nameParts()
            own = [parts.apply(k) for k in range(parts.size())]
            found.append((".".join(own[:-1]) or None, own[-1]))
    return found
