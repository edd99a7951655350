"""Metadata of the source as DataFrames: its surface, columns and row counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.sources.guard import Source


def surface(source: Source) -> DataFrame:
    """(view, kind, can_select) of each view: whether a row of it, or its lack of rows, can be read now."""
    rows = []
    for name, df in sorted(source.views.items()):
        try:
            df.take(1)
            ok = True
        except Exception:
            ok = False
        rows.append((name, "VIEW", ok))
    return source.spark.createDataFrame(rows, "view string, kind string, can_select boolean")


def columns(spark: SparkSession, views: dict[str, DataFrame]) -> DataFrame:
    """(view, position, column_name, data_type), in order."""
    rows = [(v, i, f.name, f.dataType.simpleString()) for v, df in sorted(views.items()) for i, f in enumerate(df.schema.fields, 1)]
    return spark.createDataFrame(rows, "view string, position int, column_name string, data_type string")


def row_counts(views: dict[str, DataFrame]) -> DataFrame:
    """(view, row_count, status), in one job over all views; counts come from file metadata where the format has them."""
    out = None
    for v, df in sorted(views.items()):
        one = df.agg(F.count("*").alias("row_count")).select(F.lit(v).alias("view"), "row_count", F.lit("exact").alias("status"))
        out = one if out is None else out.unionByName(one)
    return out


def counted(source: Source, view: str, timeout_s: float | None = None) -> tuple[int | None, str]:
    """(rows, status) of a view: exact; approximate, from file footers, if counting takes longer than timeout_s; or
    indeterminate if its files say nothing."""
    exact = source.within(timeout_s, source.views[view].count)
    if exact is not None:
        return exact, "exact"
    guess = footer_rows(source.views[view])
    return guess, "indeterminate" if guess is None else "approximate"


def footer_rows(df: DataFrame) -> int | None:
    """Rows of the Parquet files that a view reads, from their footers alone; None if it doesn't read Parquet files.

    A filter or join of the view doesn't count, so this is an upper bound of a filtered table.
    """
    files = df.inputFiles()
    if not files or not all(f.endswith(".parquet") for f in files):
        return None
    rows = df.sparkSession.read.parquet(*files).groupBy().agg(F.count("*").alias("n"))  # a count without columns is read from footers
    return rows.first()["n"]


def summary(surface_df: DataFrame) -> DataFrame:
    """Number of objects, and of those that can be selected, of each kind."""
    return surface_df.groupBy("kind").agg(F.count("*").alias("objects"), F.count_if("can_select").alias("selectable"))
