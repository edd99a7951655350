"""Canonical forms that identify things: keys as JSON, ids as hashes."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Mapping
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F


def key_json(columns: list[str]) -> Column:
    """Key columns as JSON: names sorted, no blanks, nulls left out."""
    return F.to_json(F.struct(*sorted(columns)))


def dedupe_key(check_id: str, key: Mapping[str, Any]) -> str:
    """What findings.dedupe_key gives for a key of numbers and strings, on the driver."""
    own = {k: v for k, v in sorted(key.items()) if v is not None}
    return hashlib.sha256(f"{check_id}:{json.dumps(own, separators=(',', ':'), ensure_ascii=False)}".encode()).hexdigest()


def document_hash(document: Any) -> str:
    """Of a JSON document, whatever the order of its keys."""
    return hashlib.sha256(json.dumps(document, sort_keys=True, default=str).encode()).hexdigest()
