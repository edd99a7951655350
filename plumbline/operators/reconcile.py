"""What is documented against what is there, by case-insensitive names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def type_family(c: Column) -> Column:
    """numeric, float, string, date or other, of Spark's and SQL Server's type names."""
    t = F.lower(F.regexp_replace(c, r"\(.*", ""))
    return (
        F.when(t.isin("int", "integer", "bigint", "smallint", "tinyint", "decimal", "numeric", "bit", "long"), "numeric")
        .when(t.isin("float", "double", "real", "money", "smallmoney"), "float")
        .when(t.isin("string", "char", "varchar", "nchar", "nvarchar", "text", "ntext"), "string")
        .when(t.isin("date", "datetime", "datetime2", "smalldatetime", "datetimeoffset", "timestamp", "timestamp_ntz"), "date")
        .otherwise("other")
    )


def columns(documented: DataFrame, live: DataFrame) -> DataFrame:
    """(view, column_name, discrepancy): documented_missing_live, undocumented_live_column or type_mismatch.

    Both sides: view, column_name, data_type. A view without documentation has no undocumented columns.
    """
    key = lambda df, p: df.select(F.lower("view").alias("v"), F.lower("column_name").alias("c"), F.col("data_type").alias(p))
    both = key(documented, "d").join(key(live, "l"), ["v", "c"], "full_outer").join(documented.select(F.lower("view").alias("v")).distinct().withColumn("known", F.lit(True)), "v", "left")
    found = F.when(F.col("l").isNull(), "documented_missing_live").when(F.col("d").isNull(), F.when(F.col("known"), "undocumented_live_column")).when(type_family(F.col("d")) != type_family(F.col("l")), "type_mismatch")
    return both.select(F.col("v").alias("view"), F.col("c").alias("column_name"), found.alias("discrepancy")).where("discrepancy IS NOT NULL")


def surface(exported: DataFrame, live: DataFrame) -> DataFrame:
    """(view, status): matched, missing (exported only) or extra (live only)."""
    e = exported.select(F.lower("view").alias("view")).distinct().withColumn("e", F.lit(True))
    l = live.select(F.lower("view").alias("view")).distinct().withColumn("l", F.lit(True))  # noqa: E741
    status = F.when(F.col("l").isNull(), "missing").when(F.col("e").isNull(), "extra").otherwise("matched")
    return e.join(l, "view", "full_outer").select("view", status.alias("status"))


def relations(hypotheses: DataFrame, live: DataFrame) -> DataFrame:
    """(view_a, view_b, shared): columns ending in id that both views of a documented relation have; corroborates it."""
    ids = live.where(F.lower("column_name").endswith("id")).select(F.lower("view").alias("v"), F.lower("column_name").alias("c"))
    a = hypotheses.join(ids.select(F.col("v").alias("va"), F.col("c").alias("ca")), F.lower("view_a") == F.col("va"))
    both = a.join(ids.select(F.col("v").alias("vb"), F.col("c").alias("cb")), (F.lower("view_b") == F.col("vb")) & (F.col("ca") == F.col("cb")))
    return both.groupBy("view_a", "view_b").agg(F.sort_array(F.collect_set("ca")).alias("shared"))
