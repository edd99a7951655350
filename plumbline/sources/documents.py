"""Other documents that come in or go out: what an export is said to hold, baselines, the environment, prompts."""

from __future__ import annotations

import json
from datetime import datetime
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators import profile
from plumbline.plans.document import ACTIONS
from plumbline.sources.guard import Source


def hypotheses(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(documented columns, documented relations) of JSON: {"views": [{"view", "columns": [{"name", "type"}]}], "relations": [{"view_a", "view_b"}]}."""
    schema = "views array<struct<view: string, columns: array<struct<name: string, type: string>>>>, relations array<struct<view_a: string, view_b: string>>"
    doc = spark.read.schema(schema).option("multiLine", True).json(path)
    columns = doc.select(F.explode("views").alias("v")).select("v.view", F.explode("v.columns").alias("c")).select("view", F.col("c.name").alias("column_name"), F.col("c.type").alias("data_type"))
    return columns, doc.select(F.explode("relations").alias("r")).select("r.*")


def export_names(spark: SparkSession, path: str) -> DataFrame:
    """(view) of a text file of names, one a line, blank lines and # comments left out."""
    line = F.trim(F.regexp_replace("value", "#.*", ""))
    return spark.read.text(path).select(line.alias("view")).where("view <> ''")


def documented_columns(df: DataFrame, view: str, text: str) -> DataFrame:
    """(view, column_name, data_type) of prose with lines such as `| name | type |`."""
    rows = F.explode(F.regexp_extract_all(F.col(text), F.lit(r"(?m)^\s*\|?\s*([A-Za-z_]\w*)\s*\|\s*([A-Za-z]\w*(?:\([\d, ]+\))?)\s*\|?\s*$"), F.lit(0)))
    part = lambda n: F.regexp_extract("line", r"([A-Za-z_]\w*)\s*\|\s*([A-Za-z]\w*(?:\([\d, ]+\))?)", n)
    return df.select(view, rows.alias("line")).select(view, part(1).alias("column_name"), part(2).alias("data_type"))


def actions(spark: SparkSession) -> DataFrame:
    """(code, title, description) of the curated actions."""
    return spark.createDataFrame([tuple(a) for a in ACTIONS], "code string, title string, description string")


def environment(source: Source, watermarks: dict[str, list[str]], as_of: datetime) -> dict[str, Any]:
    """What a source looks like: version, surface, exact row counts, and the fitness of watermark columns."""
    out: dict[str, Any] = {"spark_version": source.spark.version, "as_of": as_of.isoformat(), "views": []}
    for name, df in sorted(source.views.items()):
        fit = [r.asDict() for r in profile.watermark_fitness(df, watermarks[name], as_of).collect()] if watermarks.get(name) else []
        out["views"].append({"view": name, "columns": len(df.columns), "rows": df.count(), "watermarks": fit})
    return out


def write_environment(path: str, found: dict[str, Any]) -> None:
    """The report as JSON and, beside it, as Markdown."""
    Path(path).write_text(json.dumps(found, sort_keys=True, indent=1, default=str), encoding="utf-8")
    lines = [f"# Environment: Spark {found['spark_version']}", "", "| view | rows | columns | watermarks |", "|-|-|-|-|"]
    lines += [f"| {v['view']} | {v['rows']} | {v['columns']} | {', '.join(w['column_name'] + (' fits' if w['fit'] else ': ' + w['reason']) for w in v['watermarks']) or '-'} |" for v in found["views"]]
    Path(path).with_suffix(".md").write_text("\n".join(lines) + "\n", encoding="utf-8")


def baselines(path: str) -> dict[str, dict[str, datetime]]:
    """Earlier maxima of watermark columns, by view, of an environment report."""
    found = json.loads(Path(path).read_text(encoding="utf-8"))
    return {v["view"]: {w["column_name"]: datetime.fromisoformat(w["max_value"]) for w in v["watermarks"] if w["fit"] and w["max_value"]} for v in found["views"]}


def record_prompt(path: str, prompt: str, answer: str, mode: str) -> None:
    """A line of what was said to a model, and in which redaction mode."""
    with open(path, "a", encoding="utf-8") as f:
        f.write(json.dumps({"mode": mode, "prompt": prompt, "answer": answer}) + "\n")
