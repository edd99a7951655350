"""Catalog documents on disk: versions, a manifest, a report, and per-view checkpoints."""

from __future__ import annotations

import json
import re
from pathlib import Path
from typing import Any

from plumbline.functions.canonical import document_hash


def next_version(folder: str) -> int:
    found = [int(m[1]) for p in Path(folder).glob("catalog-v*.json") if (m := re.fullmatch(r"catalog-v(\d+)\.json", p.name))]
    return max(found, default=0) + 1


def check_shape(found: dict[str, Any]) -> None:
    """ValueError unless the document has the parts that readers rely on."""
    for part in ("views", "relationships", "pruning"):
        if part not in found:
            raise ValueError(f"catalog: missing {part!r}")
    for v in found["views"]:
        missing = {"qualified_name", "row_count", "archetype", "columns", "candidate_keys", "sentinels"} - set(v)
        if missing:
            raise ValueError(f"catalog view {v.get('qualified_name')!r}: missing {sorted(missing)}")


def write(folder: str, found: dict[str, Any]) -> tuple[int, str]:
    """Writes the next version and its line in the manifest; its number and hash."""
    check_shape(found)
    n, digest = next_version(folder), document_hash(found)
    Path(folder).mkdir(parents=True, exist_ok=True)
    Path(folder, f"catalog-v{n}.json").write_text(json.dumps(found, sort_keys=True, indent=1, default=str), encoding="utf-8")
    with Path(folder, "manifest.jsonl").open("a", encoding="utf-8") as f:
        f.write(json.dumps({"version": n, "sha256": digest}) + "\n")
    return n, digest


def read(folder: str, version: int | None = None) -> dict[str, Any]:
    n = version or next_version(folder) - 1
    return json.loads(Path(folder, f"catalog-v{n}.json").read_text(encoding="utf-8"))


def columns(found: dict[str, Any]) -> dict[str, list[str]]:
    """View to its pinned column names."""
    return {v["qualified_name"]: [c["column_name"] for c in v["columns"]] for v in found["views"]}


def report(found: dict[str, Any]) -> str:
    lines = ["# Profile", "", "| view | rows | archetype | columns | keys | sentinels |", "|-|-|-|-|-|-|"]
    lines += [f"| {v['qualified_name']} | {v['row_count']} | {v['archetype']} | {len(v['columns'])} | {', '.join('+'.join(k) for k in v['candidate_keys']) or '-'} | {len(v['sentinels'])} |" for v in found["views"]]
    lines += ["", f"Column pairs evaluated: {found['pruning'].get('evaluated', 0)}, skipped for cost: {found['pruning'].get('skipped_cost', 0)}."]
    return "\n".join(lines) + "\n"
