"""Views of a database: read in parallel by ranges of a key, filters and aggregates left to the database."""

from __future__ import annotations

from datetime import date, datetime
from decimal import Decimal
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators.profile import family

#: Rows fetched at a time, and tasks that read a table side by side.
FETCH, TASKS = 10_000, 16


def _shown(value: Any) -> str:
    return value.isoformat(sep=" ") if isinstance(value, datetime) else value.isoformat() if isinstance(value, date) else str(value)


def view(spark: SparkSession, url: str, name: str, *, key: str | None = None, tasks: int = TASKS, properties: dict[str, str] | None = None) -> DataFrame:
    """A table or view of a database as a DataFrame.

    key: a numeric or time column; each task reads one range of it, the first one's rows without a key too, so no row is
    lost whatever lies outside the ends found now. Without a key, or over an empty table, one task reads all. Filters,
    columns, limits and plain aggregates go to the database, so a count or a key's ends cost no transfer of rows.
    """
    options = {"url": url, "dbtable": name, "fetchsize": str(FETCH), "pushDownAggregate": "true", "pushDownLimit": "true"} | (properties or {})
    read = spark.read.format("jdbc").options(**options)
    whole = read.load()
    if key is None or tasks < 2:
        return whole
    kind = family(whole.schema[key].dataType)
    if kind not in ("numeric", "date"):
        raise ValueError(f"{name}.{key} is neither a number nor a time")
    low, high = whole.agg(F.min(key), F.max(key)).first()
    if low is None or low == high:
        return whole
    if isinstance(low, Decimal):
        low, high = int(low), int(high) + 1
    return read.options(partitionColumn=key, lowerBound=_shown(low), upperBound=_shown(high), numPartitions=str(tasks)).load()


def views(spark: SparkSession, url: str, keys: dict[str, str | None], *, tasks: int = TASKS, properties: dict[str, str] | None = None) -> dict[str, DataFrame]:
    """Several views by name, each with the key that it is read by."""
    return {name: view(spark, url, name, key=key, tasks=tasks, properties=properties) for name, key in keys.items()}
