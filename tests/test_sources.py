"""Databases as sources, and audit tables."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from plumbline.operators.run import run
from plumbline.plans.document import from_dict
from plumbline.sources import jdbc
from plumbline.sources.guard import Source, TableSink
from plumbline.sources.state import Store

CHECK = from_dict({"id": "negative", "title": "t", "category": "workflow", "default_severity": "low", "entity": {"view": "APP.VISITS", "key": ["ID"], "practice_column": "PRACTICE", "base_filters": []}, "params": {}, "prerequisites": [], "predicate": "VALUE < 0", "evidence": ["ID"], "actions": ["correct-record"], "resolution": "r"})


@pytest.fixture(scope="module")
def url(spark, tmp_path_factory):
    """An embedded database in memory."""
    found = "jdbc:derby:memory:plumbline;create=true"
    spark.sparkContext._jvm.System.setProperty("derby.system.home", str(tmp_path_factory.mktemp("derby")))
    rows = spark.range(1_000).selectExpr("CAST(id AS INT) AS ID", "CAST(id % 5 AS INT) AS PRACTICE", "CAST(id % 4 - 1 AS DOUBLE) AS VALUE", "CAST('2024-01-01' AS TIMESTAMP) + make_interval(0, 0, 0, CAST(id % 30 AS INT)) AS AT", "CONCAT('n', id) AS NAME")
    try:
        rows.write.format("jdbc").options(url=found, dbtable="APP.VISITS", driver="org.apache.derby.jdbc.EmbeddedDriver").mode("overwrite").save()
        rows.limit(0).write.format("jdbc").options(url=found, dbtable="APP.NOBODY", driver="org.apache.derby.jdbc.EmbeddedDriver").mode("overwrite").save()
    except Exception as e:  # noqa: BLE001
        pytest.skip(f"no embedded database here: {getattr(e, 'java_exception', e)}")
    return found


def test_ranges_of_a_key(spark, url):
    df = jdbc.view(spark, url, "APP.VISITS", key="ID", tasks=4)
    assert df.rdd.getNumPartitions() == 4 and df.count() == 1_000 and df.agg(F.countDistinct("ID")).first()[0] == 1_000
    assert jdbc.view(spark, url, "APP.VISITS").rdd.getNumPartitions() == 1
    assert jdbc.view(spark, url, "APP.VISITS", key="AT", tasks=3).count() == 1_000
    assert jdbc.view(spark, url, "APP.NOBODY", key="ID").count() == 0
    with pytest.raises(ValueError, match="neither"):
        jdbc.view(spark, url, "APP.VISITS", key="NAME")


def test_filters_reach_the_database(spark, url):
    plan = jdbc.view(spark, url, "APP.VISITS", key="ID").where("VALUE < 0").select("ID")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [" in plan and "LessThan(VALUE,0.0)" in plan.replace("*", "")


def test_a_run_over_a_database(spark, url, tmp_path):
    sink = TableSink(spark, f"file://{tmp_path}/audit")
    source = Source(spark, jdbc.views(spark, url, {"APP.VISITS": "ID"}, tasks=3), sinks=[sink])
    r = run(source, Store(spark, f"file://{tmp_path}/state"), [CHECK], run_id="r1", as_of=datetime(2024, 6, 30))
    assert r.stats["created"] == 250 and sink.held == []
    told = spark.read.parquet(f"file://{tmp_path}/audit")
    assert told.count() >= 2 and {x["run_id"] for x in told.collect()} == {"r1"}


def test_audit_tables_keep_what_is_held(spark, tmp_path):
    with TableSink(spark, f"file://{tmp_path}/a", every=3) as sink:
        source = Source(spark, {"app.t": spark.range(2)}, sinks=[sink])
        for _ in range(4):
            source.execute("SELECT id FROM app__t")
        assert spark.read.parquet(f"file://{tmp_path}/a").count() == 3 and len(sink.held) == 1
    assert spark.read.parquet(f"file://{tmp_path}/a").count() == 4
