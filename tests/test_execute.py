import itertools
from datetime import datetime

import pytest

from plumbline import checks
from plumbline.operators import execute
from plumbline.plans.document import from_dict
from plumbline.sources.guard import GuardError, JsonlSink, Source

NOW = datetime(2024, 6, 30)


def made(predicate, prerequisites=(), base=()):
    return from_dict({"id": "x", "title": "t", "category": "policy", "default_severity": "low", "entity": {"view": "t.v", "key": ["id"], "practice_column": "g", "base_filters": list(base)}, "params": {}, "prerequisites": list(prerequisites), "predicate": predicate, "evidence": ["id"], "actions": ["correct-record"], "resolution": "r"})


def test_truth_table(spark):
    values = (True, False, None)
    rows = [(n, 1, *v) for n, v in enumerate(itertools.product(values, repeat=3))]
    df = spark.createDataFrame(rows, "id int, g int, a boolean, b boolean, c boolean")

    def both(x, y):
        return False if x is False or y is False else None if x is None or y is None else True

    def either(x, y):
        return True if x is True or y is True else None if x is None or y is None else False

    def negate(x):
        return None if x is None else not x

    for node, want in (({"all": ["a", "b"]}, both), ({"any": ["a", "b"]}, either), ({"not": {"any": ["a", {"not": "b"}]}}, lambda x, y: negate(either(x, negate(y))))):
        got = {r["id"]: r["tri_state"] for r in execute.execute(Source(spark, {"t.v": df}), made(node, ["c"]), as_of=NOW).collect()}
        for n, _, a, b, c in rows:
            p = want(a, b)
            assert got[n] == ("indeterminate" if c is not True or p is None else "fail" if p else "pass")


@pytest.fixture(scope="module")
def clinic(spark):
    d = lambda n: datetime(2024, 6, 30 - n)
    appointments = [(1, 1, d(20), 1, "2-HIGH", 0, 100), (2, 1, d(20), 1, "2-HIGH", 0, 100), (3, 1, d(20), 0, "x", 0, 100), (4, 1, d(2), 1, None, 0, 100), (5, 1, d(20), None, "x", 0, 100), (6, 1, None, 1, "x", 0, 100), (7, 1, d(20), 1, "x", 1, 100)]
    invoices = [(1, 1, 1, 1, d(1), 0, None), (2, 1, 1, 1, d(1), 1, None)]
    return {
        "clinic.appointments": spark.createDataFrame(appointments, "id int, patient int, schedule_date timestamp_ntz, completed int, status string, is_deleted int, practice int"),
        "clinic.invoices": spark.createDataFrame(invoices, "appointment int, line int, part int, supplier int, invoice_date timestamp_ntz, active int, total decimal(18,2)"),
    }


def test_fixture_outcomes_row_by_row(spark, clinic):
    rows = execute.execute(Source(spark, clinic), checks.load("appointment-completed-no-invoice"), as_of=NOW)
    assert {r["id"]: r["tri_state"] for r in rows.collect()} == {1: "fail", 2: "pass", 3: "pass", 4: "pass", 5: "indeterminate", 6: "indeterminate"}
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ExistenceJoin") == 1


def test_domain_and_fused_rows_agree_with_single_checks(spark, clinic):
    source = Source(spark, clinic)
    both = [checks.load("appointment-completed-no-invoice"), checks.load("appointment-unknown-status")]
    fused = execute.run_rows(source, both, as_of=NOW)
    for c in both:
        single = {str(r["id"]): r["tri_state"] for r in execute.execute(source, c, as_of=NOW).collect()}
        assert {r["entity_key"][6:-1]: r["tri_state"] for r in fused.where(fused.check_id == c.id).collect()} == single
    t = {r["check_id"]: r for r in execute.tally(fused).collect()}
    assert (t["appointment-unknown-status"]["n_fail"], t["appointment-unknown-status"]["n_pass"], t["appointment-unknown-status"]["n_indeterminate"]) == (4, 2, 1)


def test_practice_scope_params_and_windows(spark, clinic):
    source, check = Source(spark, clinic), checks.load("appointment-completed-no-invoice")
    assert execute.execute(source, check, as_of=NOW, practice_id=5).count() == 0
    assert execute.execute(source, check, as_of=NOW, params={"invoice_lag_days": 25.5}).where("tri_state = 'fail'").count() == 0
    w = execute.increment("schedule_date", datetime(2024, 6, 20), NOW)
    assert [r["id"] for r in execute.execute(source, check, as_of=NOW, window=w).collect()] == [4]
    assert execute.increment("c", None, NOW).args()["wm_from"] is None
    assert execute.depends_on_now(check) and not execute.depends_on_now(checks.load("invoice-negative-total"))


def test_drift_and_key_set_hash(spark):
    assert execute.drift(["a", "B"], ["b", "c"]) == ["a"]
    a, b = (spark.createDataFrame([(x,) for x in xs], "entity_key string") for xs in ("xyz", "zyxx"))
    assert execute.key_set_hash(a).first() == execute.key_set_hash(b).first()
    assert execute.key_set_hash(a).first()["hash"] != execute.key_set_hash(a.limit(2)).first()["hash"]
    assert execute.key_set_hash(a.limit(0)).first()["n"] == 0


def test_indeterminacy_findings(spark):
    t = spark.createDataFrame([("c", "1", 10, 1, 1, 8, 0.8), ("d", "1", 10, 5, 5, 0, 0.0), ("e", "1", 0, 0, 0, 0, None)], "check_id string, practice_id string, n_examined long, n_fail long, n_pass long, n_indeterminate long, indeterminate_rate double")
    assert sorted(r["tri_state"] for r in execute.indeterminacy_findings(t).collect()) == ["fail", "pass"]


@pytest.mark.parametrize("sql", ["DROP TABLE t__v", "SELECT 1; SELECT 2", "INSERT INTO t__v SELECT 1", "SELECT * FROM other", "SELECT * FROM t__v WHERE id IN (SELECT x FROM other)", "SELEC 1", "CREATE VIEW w AS SELECT 1", "SELECT o.x FROM (WITH secret AS (SELECT 1 AS y) SELECT y FROM secret) i, secret o", "SELECT * FROM range(3)", "SELECT reflect('java.lang.System', 'getProperty', 'user.name') FROM t__v", "SELECT id FROM t__v WHERE id IN (SELECT `java_method`('java.util.UUID', 'randomUUID'))", "WITH a AS (SELECT * FROM b), b AS (SELECT 1) SELECT * FROM a", "SELECT TRANSFORM(id) USING 'cat' FROM t__v", "SET x = 1", "FROM t__v SELECT TRANSFORM(id) USING 'cat'"])
def test_guard_refuses(spark, tmp_path, sql):
    source = Source(spark, {"t.v": spark.range(3)}, sinks=[JsonlSink(str(tmp_path / "audit"))])
    with pytest.raises(GuardError):
        source.execute(sql)
    assert not (tmp_path / "audit").exists()


def test_guard_allows_widens_and_audits(spark, tmp_path):
    source = Source(spark, {"t.v": spark.range(3)}, sinks=[JsonlSink(str(tmp_path / "audit"))])
    assert source.execute("WITH w AS (SELECT * FROM t__v) SELECT count(*) AS n FROM w").first()["n"] == 3
    assert len((tmp_path / "audit").read_text().splitlines()) == 1
    spark.range(2).createOrReplaceTempView("more")
    wider = source.allowing(["more"])
    assert wider.execute("SELECT * FROM more").count() == 2
    with pytest.raises(GuardError):
        source.execute("SELECT * FROM more")


@pytest.mark.parametrize(
    "sql",
    [
        "SELECT IDENTIFIER('java_'||'method')('java.lang.System', 'currentTimeMillis')",
        "SELECT id FROM app__t WHERE IDENTIFIER('ref'||'lect')('java.lang.System', 'lineSeparator') = id",
        "SELECT * FROM IDENTIFIER('secret'||'s')",
        "SELECT system.builtin.java_method('java.lang.System', 'currentTimeMillis')",
        "SELECT `reflect`('java.lang.System', 'currentTimeMillis') FROM app__t",
        "SELECT own_code(id) FROM app__t",
        "SELECT (SELECT max(own_code(id)) FROM app__t)",
        "SELECT input_file_name() FROM app__t",
    ],
)
def test_functions_that_are_not_sparks_own_are_refused(spark, sql):
    spark.udf.register("own_code", lambda x: x)
    source = Source(spark, {"app.t": spark.range(2)})
    with pytest.raises(GuardError):
        source.execute(sql)


def test_sparks_own_functions_pass(spark):
    source = Source(spark, {"app.t": spark.range(3)})
    sql = "SELECT upper(CAST(id AS STRING)) u, filter(array(id, 1), x -> x > 0) f, coalesce(nullif(id, 1), date_diff(DATE '2020-01-02', DATE '2020-01-01')) c, EXTRACT(YEAR FROM TIMESTAMP '2020-01-01 00:00:00') y, row_number() OVER (ORDER BY id) n, count(*) OVER () k, id IN (1, 2) i, CASE WHEN id LIKE '1%' THEN 'it''s java_method(x)' END t FROM app__t WHERE id BETWEEN 0 AND 2 AND EXISTS (SELECT 1 FROM app__t b WHERE b.id = app__t.id)"
    assert source.execute(sql).count() == 3
