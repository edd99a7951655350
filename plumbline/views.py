"""Views of the driver's tables with the nulls and planted cases that checks need; the same SQL runs on Spark and DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "labels", "documents", "pages", "benchmark", "conversations")

#: View name to (SQL, tables it reads).
VIEWS: dict[str, tuple[str, tuple[str, ...]]] = {
    "clinic.appointments": (
        """SELECT o_orderkey AS id, o_custkey AS patient, CASE WHEN o_orderkey % 97 = 0 THEN NULL ELSE o_orderdate END AS schedule_date,
             CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 0 END AS completed,
             CASE WHEN o_orderkey % 89 = 0 THEN NULL ELSE o_orderpriority END AS status,
             CASE WHEN o_orderkey % 11 = 0 THEN 1 ELSE 0 END AS is_deleted, c_nationkey AS practice
           FROM orders JOIN customer ON o_custkey = c_custkey""",
        ("orders", "customer"),
    ),
    "clinic.invoices": (
        """SELECT l_orderkey AS appointment, l_linenumber AS line, l_partkey AS part, l_suppkey AS supplier, l_shipdate AS invoice_date,
             CASE WHEN l_returnflag <> 'R' THEN 1 ELSE 0 END AS active,
             CASE WHEN l_partkey % 101 = 0 THEN NULL WHEN l_linenumber = 7 THEN CAST(-l_extendedprice * (1 - l_discount) AS DECIMAL(18,2))
                  ELSE CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(18,2)) END AS total
           FROM lineitem""",
        ("lineitem",),
    ),
    "clinic.patients": (
        """SELECT c_custkey AS id, CASE WHEN c_custkey % 53 = 0 THEN NULL ELSE 1 END AS active,
             CASE WHEN c_custkey % 17 = 0 THEN NULL ELSE c_name END AS nhi, CASE WHEN c_mktsegment = 'BUILDING' THEN 1 ELSE 0 END AS high_care,
             c_acctbal AS balance, c_nationkey AS practice
           FROM customer""",
        ("customer",),
    ),
    "clinic.vocabulary": ("SELECT p_partkey AS id, concat(p_name, ' (', p_type, ')') AS name FROM part", ("part",)),
    "clinic.feedback": (
        """SELECT event_id, user_id % 7 AS practice_id, event_type AS check_id,
             CASE WHEN value < 8 * (user_id % 7 + 1) THEN 'genuine_issue' ELSE 'not_genuine' END AS reason_code, ts AS occurred_at
           FROM events""",
        ("events",),
    ),
    "clinic.sentinels": (
        """SELECT CASE WHEN o_orderkey % 10 = 0 THEN 0 ELSE o_orderkey END AS visitid,
             CASE WHEN o_orderkey % 50 = 0 THEN CAST('1900-01-01 00:00:00' AS TIMESTAMP) ELSE CAST(o_orderdate AS TIMESTAMP) END AS seen_at,
             CASE WHEN o_orderkey % 9 = 0 THEN NULL WHEN o_orderkey % 6 = 0 THEN '' ELSE o_orderstatus END AS status,
             CASE WHEN o_orderkey % 5 = 0 THEN 'other' ELSE 'usual' END AS channel
           FROM orders""",
        ("orders",),
    ),
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """An adapted view over the tables of a folder."""
    sql, names = VIEWS[name]
    return spark.sql(_braced(sql, names), **{n: table(spark, sf_dir, n) for n in names})


def _braced(sql: str, names: tuple[str, ...]) -> str:
    import re

    for n in names:
        sql = re.sub(rf"(?<=FROM |JOIN ){n}\b", "{" + n + "}", sql)
    return sql


def views(spark: SparkSession, sf_dir: str, *names: str) -> dict[str, DataFrame]:
    return {n: view(spark, sf_dir, n) for n in names}


def with_views(sql: str, *names: str) -> str:
    """DuckDB SQL over adapted views, by the last part of their names."""
    ctes = ", ".join(f"{n.split('.')[1]} AS ({VIEWS[n][0]})" for n in names)
    sql = sql.strip()
    return f"WITH {ctes}, {sql[5:]}" if sql.upper().startswith("WITH ") else f"WITH {ctes} {sql}"
