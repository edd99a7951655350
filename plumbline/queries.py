"""The registered queries of the check engine, each with equivalent SQL for DuckDB."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline import checks
from plumbline.drafts_sql import VIEWS as DRAFT_VIEWS
from plumbline.drafts_sql import drafts_sql
from plumbline.operators import calibration, compose, dashboard, execute, feedback, findings, jobs, keysets, narrate, profile, reconcile, registry, review, sketches
from plumbline.operators.run import history, run
from plumbline.plans.document import ACTIONS, from_dict
from plumbline.sources import documents, tables
from plumbline.sources.guard import Source
from plumbline.sources.state import Store
from plumbline.views import table, view, views, with_views

AS_OF = datetime(2001, 12, 31)
EVENTS_AS_OF = datetime(2024, 2, 1)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, *names: str):
    """Registers a query; sql: its equivalent over the driver's tables and these adapted views."""

    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = with_views(sql, *names) if names else sql
        return f

    return keep


TRI = "CASE WHEN {0} THEN CASE WHEN p THEN 'fail' WHEN NOT p THEN 'pass' ELSE 'indeterminate' END ELSE 'indeterminate' END"


def _judged(spark: SparkSession, sf_dir: str, name: str, as_of: datetime = AS_OF, **options) -> DataFrame:
    check = checks.load(name)
    return execute.execute(Source(spark, views(spark, sf_dir, *check.views)), check, as_of=as_of, **options)


def _adhoc(spark: SparkSession, sf_dir: str, view_name: str, predicate, *, prerequisites=(), base=(), key=("id",), practice="practice", joined=()) -> DataFrame:
    """Judged rows of a check made up of a few leaves."""
    doc = {"id": "ad-hoc", "title": "t", "category": "data-quality", "default_severity": "low", "entity": {"view": view_name, "key": list(key), "practice_column": practice, "base_filters": list(base)}, "params": {}, "prerequisites": list(prerequisites), "predicate": predicate, "evidence": list(key), "actions": ["correct-record"], "resolution": "r"}
    return execute.execute(Source(spark, views(spark, sf_dir, view_name, *joined)), from_dict(doc), as_of=AS_OF)


# --- judging rows ---

A_SQL = """SELECT id, practice, patient, schedule_date, """ + TRI.format("completed IS NOT NULL AND schedule_date IS NOT NULL") + """ AS tri_state
FROM (SELECT *, completed = 1 AND schedule_date <= TIMESTAMP '{as_of}' - INTERVAL {lag} DAY
  AND NOT EXISTS (SELECT 1 FROM invoices i WHERE i.appointment = a.id AND i.active = 1) AS p FROM appointments a WHERE is_deleted = 0)"""
A_VIEWS = ("clinic.appointments", "clinic.invoices")


@query(A_SQL.format(as_of="2001-12-31", lag=7), *A_VIEWS)
def q_tri_flagship(spark, sf_dir):
    return _judged(spark, sf_dir, "appointment-completed-no-invoice")


@query("SELECT id, practice, " + TRI.format("true") + " AS tri_state FROM (SELECT *, completed = 1 AS p FROM appointments WHERE is_deleted = 0 AND status <> '5-LOW')", "clinic.appointments")
def q_base_filter(spark, sf_dir):
    return _adhoc(spark, sf_dir, "clinic.appointments", "completed = 1", base=["is_deleted = 0", "status <> '5-LOW'"])


@query("SELECT id, practice, " + TRI.format("true") + " AS tri_state FROM (SELECT *, balance < 0 AS p FROM patients)", "clinic.patients")
def q_leaf_compare(spark, sf_dir):
    return _adhoc(spark, sf_dir, "clinic.patients", "balance < 0")


@query("SELECT id, practice, " + TRI.format("active IS NOT NULL") + " AS tri_state FROM (SELECT *, active = 1 AND nhi IS NULL AS p FROM patients)", "clinic.patients")
def q_null_test(spark, sf_dir):
    return _judged(spark, sf_dir, "patient-active-missing-nhi")


@query("SELECT id, practice, " + TRI.format("status IS NOT NULL AND completed = 1") + " AS tri_state FROM (SELECT *, schedule_date < TIMESTAMP '1998-01-01' AS p FROM appointments)", "clinic.appointments")
def q_prereq(spark, sf_dir):
    return _adhoc(spark, sf_dir, "clinic.appointments", "schedule_date < TIMESTAMP_NTZ '1998-01-01'", prerequisites=["status IS NOT NULL", "completed = 1"])


@query("SELECT id, practice, status, " + TRI.format("status IS NOT NULL") + " AS tri_state FROM (SELECT *, NOT (status IN ('1-URGENT', '2-HIGH', '3-MEDIUM', '5-LOW')) AS p FROM appointments)", "clinic.appointments")
def q_in_domain(spark, sf_dir):
    return _judged(spark, sf_dir, "appointment-unknown-status")


@query("SELECT id, practice, " + TRI.format("true") + " AS tri_state FROM (SELECT *, schedule_date >= TIMESTAMP '2001-12-31' - INTERVAL 14 MONTH AS p FROM appointments)", "clinic.appointments")
def q_date_window(spark, sf_dir):
    return _adhoc(spark, sf_dir, "clinic.appointments", "schedule_date >= DATEADD(MONTH, -14, getdate())")


@query("SELECT appointment, line, supplier, part, " + TRI.format("true") + " AS tri_state FROM (SELECT *, date_diff('day', TIMESTAMP '1998-03-01', invoice_date) > 100 AS p FROM invoices)", "clinic.invoices")
def q_datediff(spark, sf_dir):
    return _adhoc(spark, sf_dir, "clinic.invoices", "DATEDIFF(DAY, '1998-03-01', invoice_date) > 100", key=("appointment", "line", "part", "supplier"), practice="supplier")


@query("SELECT id, practice, " + TRI.format("true") + " AS tri_state FROM (SELECT *, completed = 1 AND status = '1-URGENT' AS p FROM appointments)", "clinic.appointments")
def q_and3(spark, sf_dir):
    return _adhoc(spark, sf_dir, "clinic.appointments", {"all": ["completed = 1", "status = '1-URGENT'"]})


@query("SELECT id, practice, " + TRI.format("true") + " AS tri_state FROM (SELECT *, completed = 1 OR status = '1-URGENT' AS p FROM appointments)", "clinic.appointments")
def q_or3(spark, sf_dir):
    return _adhoc(spark, sf_dir, "clinic.appointments", {"any": ["completed = 1", "status = '1-URGENT'"]})


@query("SELECT id, practice, " + TRI.format("true") + " AS tri_state FROM (SELECT *, NOT (completed = 1 AND NOT (status = '1-URGENT')) AS p FROM appointments)", "clinic.appointments")
def q_not3(spark, sf_dir):
    return _adhoc(spark, sf_dir, "clinic.appointments", {"not": {"all": ["completed = 1", {"not": "status = '1-URGENT'"}]}})


@query("SELECT id, practice, " + TRI.format("true") + " AS tri_state FROM (SELECT *, EXISTS (SELECT 1 FROM invoices i WHERE i.appointment = a.id AND i.total < 0) AS p FROM appointments a)", *A_VIEWS)
def q_exists(spark, sf_dir):
    return _adhoc(spark, sf_dir, "clinic.appointments", {"exists": {"view": "clinic.invoices", "on": "clinic.invoices.appointment = clinic.appointments.id", "where": "clinic.invoices.total < 0"}}, joined=["clinic.invoices"])


@query("SELECT id, practice, balance, " + TRI.format("active IS NOT NULL") + """ AS tri_state FROM (SELECT *, (high_care = 1 OR balance < 0) AND NOT EXISTS (
  SELECT 1 FROM appointments a WHERE a.patient = t.id AND a.schedule_date >= TIMESTAMP '2001-12-31' - INTERVAL 365 DAY) AS p FROM patients t)""", "clinic.patients", "clinic.appointments")
def q_not_exists(spark, sf_dir):
    return _judged(spark, sf_dir, "patient-no-recent-appointment")


@query("SELECT id, practice, " + TRI.format("true") + " AS tri_state FROM (SELECT *, EXISTS (SELECT 1 FROM appointments a WHERE a.patient = t.id AND a.practice >= t.practice AND a.id > t.id * 40) AS p FROM patients t)", "clinic.patients", "clinic.appointments")
def q_exists_theta(spark, sf_dir):
    return _adhoc(spark, sf_dir, "clinic.patients", {"exists": {"view": "clinic.appointments", "on": "clinic.appointments.patient = clinic.patients.id AND clinic.appointments.practice >= clinic.patients.practice AND clinic.appointments.id > clinic.patients.id * 40"}}, joined=["clinic.appointments"])


@query("SELECT appointment, line, part, supplier, CASE WHEN count(*) OVER (PARTITION BY appointment, line) > 1 THEN 'fail' ELSE 'pass' END AS tri_state FROM invoices", "clinic.invoices")
def q_duplicate(spark, sf_dir):
    return _judged(spark, sf_dir, "invoice-line-duplicate")


INCREMENT = (datetime(1998, 1, 1), datetime(1998, 3, 1))


@query("""SELECT appointment, line, part, supplier, CASE WHEN (SELECT count(*) FROM invoices o WHERE o.appointment = i.appointment AND o.line = i.line) > 1 THEN 'fail' ELSE 'pass' END AS tri_state
  FROM invoices i WHERE invoice_date > TIMESTAMP '1998-01-01' AND invoice_date <= TIMESTAMP '1998-03-01'""", "clinic.invoices")
def q_duplicate_increment(spark, sf_dir):
    """Duplicates of an increment's rows, wherever in the view the other row stands."""
    return _judged(spark, sf_dir, "invoice-line-duplicate", window=execute.Window("invoice_date", *INCREMENT, full_partition=True))


@query("SELECT event_id AS id, user_id AS practice, " + TRI.format("true") + " AS tri_state FROM (SELECT *, value > 50 AS p FROM events WHERE ts > TIMESTAMP '2024-01-10' - INTERVAL 2 DAY AND ts <= TIMESTAMP '2024-01-20')")
def q_watermark_scan(spark, sf_dir):
    return _events(spark, sf_dir, execute.increment("ts", datetime(2024, 1, 10), datetime(2024, 1, 20), execute.timedelta(days=2)))


@query("SELECT event_id AS id, user_id AS practice, " + TRI.format("true") + " AS tri_state FROM (SELECT *, value > 50 AS p FROM events WHERE ts > TIMESTAMP '2024-02-01' - INTERVAL 10 DAY AND ts <= TIMESTAMP '2024-02-01')")
def q_bounded_window(spark, sf_dir):
    return _events(spark, sf_dir, execute.trailing("ts", EVENTS_AS_OF, 10))


def _event_view(spark, sf_dir):
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("practice"), "value", "ts")


def _event_check():
    doc = {"id": "event-high-value", "title": "t", "category": "workflow", "default_severity": "low", "entity": {"view": "app.events", "key": ["id"], "practice_column": "practice", "base_filters": []}, "params": {}, "prerequisites": [], "predicate": "value > 50", "evidence": ["id"], "actions": ["correct-record"], "resolution": "r"}
    return from_dict(doc)


def _events(spark, sf_dir, window):
    return execute.execute(Source(spark, {"app.events": _event_view(spark, sf_dir)}), _event_check(), as_of=EVENTS_AS_OF, window=window)


ALL_CHECKS = ("appointment-completed-no-invoice", "appointment-unknown-status", "invoice-negative-total", "patient-active-missing-nhi", "patient-no-recent-appointment")
ALL_VIEWS = ("clinic.appointments", "clinic.invoices", "clinic.patients")
ROWS_SQL = f"""rows AS (
  SELECT 'appointment-completed-no-invoice' AS check_id, practice AS practice_id, tri_state FROM ({A_SQL.format(as_of='2001-12-31', lag=7)})
  UNION ALL SELECT 'appointment-unknown-status', practice, {TRI.format('status IS NOT NULL')} FROM (SELECT *, status NOT IN ('1-URGENT', '2-HIGH', '3-MEDIUM', '5-LOW') AS p FROM appointments)
  UNION ALL SELECT 'invoice-negative-total', supplier, {TRI.format('total IS NOT NULL')} FROM (SELECT *, total < 0 AS p FROM invoices)
  UNION ALL SELECT 'patient-active-missing-nhi', practice, {TRI.format('active IS NOT NULL')} FROM (SELECT *, active = 1 AND nhi IS NULL AS p FROM patients)
  UNION ALL SELECT 'patient-no-recent-appointment', practice, {TRI.format('active IS NOT NULL')} FROM (SELECT *, (high_care = 1 OR balance < 0) AND NOT EXISTS (
    SELECT 1 FROM appointments a WHERE a.patient = t.id AND a.schedule_date >= TIMESTAMP '2001-12-31' - INTERVAL 365 DAY) AS p FROM patients t)
), tallies AS (
  SELECT check_id, CAST(practice_id AS VARCHAR) AS practice_id, count(*) AS n_examined, count(*) FILTER (tri_state = 'fail') AS n_fail, count(*) FILTER (tri_state = 'pass') AS n_pass,
         count(*) FILTER (tri_state = 'indeterminate') AS n_indeterminate, round(count(*) FILTER (tri_state = 'indeterminate') / count(*), 6) AS indeterminate_rate
  FROM rows GROUP BY ALL
)"""


def _all_rows(spark, sf_dir):
    return execute.run_rows(Source(spark, views(spark, sf_dir, *ALL_VIEWS)), [checks.load(c) for c in ALL_CHECKS], as_of=AS_OF, slim=True)


@query(f"WITH {ROWS_SQL} SELECT * FROM tallies", *ALL_VIEWS)
def q_tally(spark, sf_dir):
    return execute.tally(_all_rows(spark, sf_dir))


@query(f"WITH {ROWS_SQL} SELECT check_id AS checked, practice_id, CASE WHEN indeterminate_rate > 0.2 THEN 'fail' ELSE 'pass' END AS tri_state FROM tallies", *ALL_VIEWS)
def q_indeterminate_rate(spark, sf_dir):
    found = execute.indeterminacy_findings(execute.tally(_all_rows(spark, sf_dir)))
    return found.select(F.get_json_object("entity_key", "$.check_id").alias("checked"), "practice_id", "tri_state")


# --- findings ---

KEY_SQL = """sha256('appointment-completed-no-invoice:{"id":' || id || '}')"""


@query(f"SELECT id, {KEY_SQL} AS dedupe_key FROM appointments WHERE is_deleted = 0", "clinic.appointments")
def q_dedupe_key(spark, sf_dir):
    a = view(spark, sf_dir, "clinic.appointments").where("is_deleted = 0")
    return a.select("id", findings.dedupe_key(F.lit("appointment-completed-no-invoice"), F.to_json(F.struct("id"))).alias("dedupe_key"))


def _two_runs(spark, sf_dir):
    """Findings before a second run, and its rows: later, and with a longer lag, so that some findings resolve."""
    check = checks.load("appointment-completed-no-invoice")
    source = Source(spark, views(spark, sf_dir, *check.views))
    first = execute.run_rows(source, [check], as_of=datetime(1998, 12, 31))
    second = execute.run_rows(source, [check], as_of=AS_OF, params={check.id: {"invoice_lag_days": 1500}})
    empty = spark.createDataFrame([], findings.FINDINGS)
    return findings.transitions(findings.relevant(first, empty), empty, "r1"), second


def _second(spark, sf_dir):
    """The transitions of the second run."""
    first, second = _two_runs(spark, sf_dir)
    before = findings.snapshot(first)
    return findings.transitions(findings.relevant(second, before), before, "r2")


TWO_SQL = f"""WITH one AS ({A_SQL.format(as_of='1998-12-31', lag=7)}), two AS ({A_SQL.format(as_of='2001-12-31', lag=1500)}), both_runs AS (
  SELECT one.id, one.practice, one.tri_state AS s1, two.tri_state AS s2 FROM one JOIN two USING (id))"""


@query(f"{TWO_SQL} SELECT {KEY_SQL} AS dedupe_key, CAST(practice AS VARCHAR) AS practice_id, 'open' AS status, 'r1' AS first_seen_run, 'r1' AS last_seen_run FROM both_runs WHERE s1 = 'fail'", *A_VIEWS)
def q_materialize_first(spark, sf_dir):
    return findings.snapshot(_two_runs(spark, sf_dir)[0]).select("dedupe_key", "practice_id", "status", "first_seen_run", "last_seen_run")


@query(f"""{TWO_SQL} SELECT {KEY_SQL} AS dedupe_key, CASE WHEN s2 = 'pass' THEN 'resolved_system' ELSE 'open' END AS status,
  CASE WHEN s1 = 'fail' THEN 'r1' ELSE 'r2' END AS first_seen_run, CASE WHEN s2 = 'indeterminate' THEN 'r1' ELSE 'r2' END AS last_seen_run
  FROM both_runs WHERE s1 = 'fail' OR s2 = 'fail'""", *A_VIEWS)
def q_materialize_second(spark, sf_dir):
    return findings.snapshot(_second(spark, sf_dir)).select("dedupe_key", "status", "first_seen_run", "last_seen_run")


@query(f"""{TWO_SQL} SELECT stat, count(*) AS n FROM (SELECT CASE WHEN s2 = 'fail' AND s1 = 'fail' THEN 'reseen' WHEN s2 = 'fail' THEN 'created' WHEN s2 = 'pass' AND s1 = 'fail' THEN 'resolved_system' END AS stat FROM both_runs)
  WHERE stat IS NOT NULL GROUP BY stat""", *A_VIEWS)
def q_materialize_stats(spark, sf_dir):
    return findings.stats(_second(spark, sf_dir))


@query(f"""{TWO_SQL} SELECT {KEY_SQL} AS dedupe_key, CASE WHEN s2 = 'pass' THEN 'resolved_system' WHEN s1 = 'fail' THEN 'reseen' ELSE 'created' END AS event, 'r2' AS run_id
  FROM both_runs WHERE s2 = 'fail' OR (s2 = 'pass' AND s1 = 'fail')""", *A_VIEWS)
def q_finding_events(spark, sf_dir):
    return findings.events(_second(spark, sf_dir), "r2", AS_OF).select("dedupe_key", "event", "run_id")


@query("""SELECT count(*) AS n, sha256(concat_ws(':', count(*)::VARCHAR, coalesce(bit_xor(h), 0)::VARCHAR, coalesce(sum(h), 0)::HUGEINT::VARCHAR)) AS hash FROM (
  SELECT CAST(list_reduce(list_transform(range(1, 16), lambda i: CAST(strpos('0123456789abcdef', substr(m, CAST(i AS INTEGER), 1)) - 1 AS BIGINT)), lambda a, b: a * 16 + b) AS BIGINT) AS h
  FROM (SELECT DISTINCT md5(CAST(c_custkey AS VARCHAR)) AS m FROM customer))""")
def q_keyset_hash(spark, sf_dir):
    return execute.key_set_hash(table(spark, sf_dir, "customer"), "c_custkey")


@query("""SELECT floor(o_orderkey / 50)::BIGINT AS bucket, count(DISTINCT o_orderkey) FILTER (o_custkey % 10 <> 3) AS n_before, count(DISTINCT o_orderkey) FILTER (o_custkey % 15 <> 7) AS n_after
  FROM orders GROUP BY 1 HAVING count(*) FILTER (o_custkey % 10 = 3 OR o_custkey % 15 = 7) > 0""")
def q_changed_ranges(spark, sf_dir):
    """Ranges of keys that differ between two versions of a view."""
    orders, where = table(spark, sf_dir, "orders"), keysets.Layout(("o_orderkey",), 0, 50)
    before, after = (keysets.summary(orders.where(kept), where) for kept in ("o_custkey % 10 <> 3", "o_custkey % 15 <> 7"))
    return keysets.changed(before, after)


@query("SELECT bucket, count(*) AS rows FROM (SELECT *, floor(o_orderkey / 50)::BIGINT AS bucket FROM orders) o WHERE bucket IN (SELECT floor(o_orderkey / 50)::BIGINT FROM orders WHERE o_custkey % 97 = 3) GROUP BY bucket")
def q_changed_rows(spark, sf_dir):
    """The rows that a run reads when keys came since the last one: those of the changed ranges."""
    orders, where = table(spark, sf_dir, "orders"), keysets.Layout(("o_orderkey",), 0, 50)
    before, after = (keysets.summary(df, where) for df in (orders.where("o_custkey % 97 <> 3"), orders))
    buckets = [r["bucket"] for r in keysets.changed(before, after).collect()]  # a row a range
    return orders.where(where.condition(buckets)).groupBy(where.bucket().alias("bucket")).agg(F.count("*").alias("rows")).where(F.col("bucket").isin(buckets))


@query(f"""{TWO_SQL} SELECT {KEY_SQL} AS dedupe_key, CASE WHEN s2 = 'pass' THEN 'resolved_system' WHEN s1 = 'fail' THEN 'reseen' ELSE 'created' END AS event
  FROM both_runs WHERE s2 = 'fail' OR (s2 = 'pass' AND s1 = 'fail') UNION ALL SELECT {KEY_SQL}, 'created' FROM both_runs WHERE s1 = 'fail'""", *A_VIEWS)
def q_repeated_run_events(spark, sf_dir):
    """The log of two runs that are each called twice."""
    check = checks.load("appointment-completed-no-invoice")
    source, store = Source(spark, views(spark, sf_dir, *check.views)), Store(spark, _scratch(spark))
    for run_id, as_of, params in (("r1", datetime(1998, 12, 31), None), ("r2", AS_OF, {check.id: {"invoice_lag_days": 1500}})):
        for _ in range(2):
            run(source, store, [check], run_id=run_id, as_of=as_of, params=params)
    return history(store).where(F.col("check_id") == check.id).select("dedupe_key", "event")


class _Breaking(Store):
    """A store whose machine goes away as the findings are to be written."""

    def write(self, name, df, *rest, **more):
        if name == "findings":
            raise RuntimeError("the machine is gone")
        return super().write(name, df, *rest, **more)


@query(f"""{TWO_SQL} SELECT {KEY_SQL} AS dedupe_key, CASE WHEN s1 = 'pass' THEN 'resolved_system' ELSE 'open' END AS status, CASE WHEN s2 = 'fail' THEN 'b' ELSE 'a' END AS first_seen_run,
  CASE WHEN s1 = 'indeterminate' THEN 'b' ELSE 'a' END AS last_seen_run, CASE WHEN s2 = 'fail' AND s1 <> 'indeterminate' THEN 2 ELSE 1 END AS events
  FROM both_runs WHERE s1 = 'fail' OR s2 = 'fail'""", *A_VIEWS)
def q_interleaved_runs(spark, sf_dir):
    """The findings, with the number of their events, of a run that broke off before another one and was then taken up."""
    check = checks.load("appointment-completed-no-invoice")
    source, root = Source(spark, views(spark, sf_dir, *check.views)), _scratch(spark)
    broken, later = {"run_id": "a", "as_of": datetime(1998, 12, 31)}, {"run_id": "b", "as_of": AS_OF, "params": {check.id: {"invoice_lag_days": 1500}}}
    try:
        run(source, _Breaking(spark, root), [check], **broken)
    except RuntimeError:
        pass
    store = Store(spark, root)
    run(source, store, [check], **later)
    run(source, store, [check], **broken)
    told = history(store).groupBy("check_id", "dedupe_key").agg(F.count("*").cast("int").alias("events"))
    found = store.read("findings", findings.FINDINGS).where(F.col("check_id") == check.id)
    return found.join(told, ["check_id", "dedupe_key"]).select("dedupe_key", "status", "first_seen_run", "last_seen_run", "events")


class _Late(Source):
    """A source whose scans take too long."""

    def within(self, seconds, job):
        return None


@query("""SELECT sha256('event-high-value:{"id":' || event_id || '}') AS dedupe_key, 'r2' AS first_seen_run FROM events WHERE value > 50 AND ts <= TIMESTAMP '2024-01-20'""")
def q_retried_scan(spark, sf_dir):
    """The findings of an incremental run behind one whose scan took too long: they begin where the last judged rows end."""
    check, seen = _event_check(), {"app.events": _event_view(spark, sf_dir)}
    store, options = Store(spark, _scratch(spark)), {"watermarks": {"app.events": "ts"}, "lookback": execute.timedelta(0)}
    run(_Late(spark, seen), store, [check], run_id="r1", as_of=datetime(2024, 1, 10), timeout_s=1, **options)
    run(Source(spark, seen), store, [check], run_id="r2", as_of=datetime(2024, 1, 20), **options)
    return store.read("findings", findings.FINDINGS).where(F.col("check_id") == check.id).select("dedupe_key", "first_seen_run")


def _scratch(spark):
    """A new folder for state, below the shared folder if there is one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="plumbline-")
    path = f"{found.rstrip('/')}/plumbline-state-{uuid.uuid4().hex}"
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


# --- registry and feedback ---

@query("SELECT event_type AS check_id, max(event_id) AS version_number FROM events GROUP BY event_type")
def q_latest_version(spark, sf_dir):
    versions = table(spark, sf_dir, "events").select(F.col("event_type").alias("check_id"), F.col("event_id").alias("version_number"))
    return registry.latest_versions(versions)


REGISTRY_SQL = """WITH c AS (SELECT DISTINCT event_type AS check_id, CASE WHEN event_type = 'error' THEN 'draft' ELSE 'active' END AS status FROM events),
  v AS (SELECT event_type AS check_id, max(event_id) AS version_number FROM events GROUP BY event_type),
  p AS (SELECT DISTINCT user_id % 7 AS practice_id, event_type AS check_id, (user_id % 7) <> 3 AS enabled, (user_id % 7) = 5 AS demoted FROM events)"""


@query(f"{REGISTRY_SQL} SELECT check_id, version_number, practice_id FROM c JOIN v USING (check_id) JOIN p USING (check_id) WHERE status = 'active' AND enabled AND NOT demoted")
def q_registry(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    c = e.select(F.col("event_type").alias("check_id"), F.when(F.col("event_type") == "error", "draft").otherwise("active").alias("status")).distinct()
    v = e.select(F.col("event_type").alias("check_id"), F.col("event_id").alias("version_number"))
    p = e.select((F.col("user_id") % 7).alias("practice_id"), F.col("event_type").alias("check_id"), (F.col("user_id") % 7 != 3).alias("enabled"), (F.col("user_id") % 7 == 5).alias("demoted")).distinct()
    return registry.active_checks(c, v, p).select("check_id", "version_number", "practice_id")


PRECISION_SQL = """WITH r AS (SELECT *, row_number() OVER (PARTITION BY practice_id, check_id ORDER BY occurred_at DESC, event_id DESC) AS k FROM feedback),
  s AS (SELECT practice_id, check_id, count(*) AS n, count(*) FILTER (reason_code = 'genuine_issue') AS genuine, round(count(*) FILTER (reason_code = 'genuine_issue') / count(*), 6) AS precision
        FROM r WHERE k <= 50 GROUP BY ALL HAVING count(*) >= 10)"""


@query(f"{PRECISION_SQL} SELECT * FROM s", "clinic.feedback")
def q_precision(spark, sf_dir):
    return calibration.precision(view(spark, sf_dir, "clinic.feedback"))


@query(f"{PRECISION_SQL} SELECT practice_id, check_id, precision FROM s WHERE precision < 0.3 AND practice_id <> 2", "clinic.feedback")
def q_demotion(spark, sf_dir):
    stats = calibration.precision(view(spark, sf_dir, "clinic.feedback")).withColumn("computed_at", F.lit(EVENTS_AS_OF))
    config = stats.select("practice_id", "check_id", (F.col("practice_id") == 2).alias("demoted"))
    return calibration.demotions(stats, config).select("practice_id", "check_id", "precision")


def _dismissed_events(spark, sf_dir):
    """A store whose findings are the events, all of them dismissed by a batch of commands."""
    e, store, none = table(spark, sf_dir, "events"), Store(spark, _scratch(spark)), F.lit(None)
    check, key = F.col("event_type").alias("check_id"), F.col("event_id").cast("string")
    store.write("findings", e.select(check, key.alias("dedupe_key"), (F.col("user_id") % 3).cast("string").alias("practice_id"), key.alias("entity_key"), F.lit("open").alias("status"), none.cast("string").alias("evidence"), F.lit("r1").alias("first_seen_run"), F.lit("r1").alias("last_seen_run"), none.cast("timestamp_ntz").alias("snoozed_until")))
    reason = F.when(F.col("event_id") % (3 + F.col("user_id") % 3) == 0, "genuine_issue").otherwise("not_genuine")
    jobs.review(store, e.select(check, key.alias("dedupe_key"), F.lit("dismiss").alias("command"), reason.alias("reason_code"), F.lit("someone").alias("actor"), none.cast("string").alias("note"), none.cast("timestamp_ntz").alias("until"), F.col("ts").cast("timestamp_ntz").alias("occurred_at")), "b1")
    return store


LOOP_SQL = """WITH d AS (SELECT CAST(user_id % 3 AS VARCHAR) AS practice_id, event_type AS check_id, event_id % (3 + user_id % 3) = 0 AS genuine,
    row_number() OVER (PARTITION BY user_id % 3, event_type ORDER BY ts DESC, 'b1:' || event_id DESC) AS k FROM events),
  p AS (SELECT practice_id, check_id, count(*) AS n, count(*) FILTER (genuine) AS genuine FROM d WHERE k <= 50 GROUP BY ALL HAVING count(*) >= 10)"""


@query(f"{LOOP_SQL} SELECT practice_id, check_id, n, genuine, round(genuine / n, 6) AS precision FROM p")
def q_logged_precision(spark, sf_dir):
    """Precision of the dismissals that a batch of commands logged."""
    return jobs.precision(_dismissed_events(spark, sf_dir), "p1", EVENTS_AS_OF).drop("computed_at")


@query(f"{LOOP_SQL} SELECT practice_id, check_id, true AS demoted, printf('precision %.4f below floor %.4f', round(genuine / n, 6), 0.3) AS demotion_reason FROM p WHERE round(genuine / n, 6) < 0.3")
def q_demoted_config(spark, sf_dir):
    """The configuration after commands, precision and demotion, each sent twice."""
    store = _dismissed_events(spark, sf_dir)
    for _ in range(2):
        jobs.precision(store, "p1", EVENTS_AS_OF)
        jobs.demote(store, "d1", EVENTS_AS_OF)
    return jobs.config(store).select("practice_id", "check_id", "demoted", "demotion_reason")


@query("SELECT DISTINCT practice_id, check_id FROM feedback", "clinic.feedback")
def q_active_pairs(spark, sf_dir):
    return calibration.active_pairs(view(spark, sf_dir, "clinic.feedback"))


@query("SELECT check_id, count(*) FILTER (reason_code = 'genuine_issue') AS genuine_issue, count(*) FILTER (reason_code = 'not_genuine') AS not_genuine FROM feedback GROUP BY check_id", "clinic.feedback")
def q_reason_dist(spark, sf_dir):
    return feedback.reason_counts(view(spark, sf_dir, "clinic.feedback"))


@query("""WITH f AS (SELECT event_id, event_type, CASE user_id % 4 WHEN 0 THEN 'open' WHEN 1 THEN 'dismissed' WHEN 2 THEN 'acknowledged' ELSE 'resolved_system' END AS old, user_id % 5 AS c FROM events),
  g AS (SELECT *, CASE WHEN c = 0 THEN true WHEN c = 1 THEN true WHEN c = 2 THEN true WHEN c = 3 THEN old = 'dismissed' ELSE false END AS ok FROM f)
  SELECT event_id AS finding, CASE WHEN NOT ok THEN old WHEN c = 0 THEN 'dismissed' WHEN c = 1 THEN 'acknowledged' WHEN c = 3 THEN 'open' ELSE old END AS status, ok AND c = 2 AS snoozed FROM g""")
def q_feedback_apply(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    none = F.lit(None)
    old = F.element_at(F.array(*map(F.lit, ("open", "dismissed", "acknowledged", "resolved_system"))), (F.col("user_id") % 4 + 1).cast("int"))
    key = F.col("event_id").cast("string")
    now = e.select(F.col("event_type").alias("check_id"), key.alias("dedupe_key"), F.lit("1").alias("practice_id"), key.alias("entity_key"), old.alias("status"), none.cast("string").alias("evidence"), F.lit("r1").alias("first_seen_run"), F.lit("r1").alias("last_seen_run"), none.cast("timestamp_ntz").alias("snoozed_until"))
    command = F.element_at(F.array(*map(F.lit, ("dismiss", "acknowledge", "snooze", "reopen", "dismiss"))), (F.col("user_id") % 5 + 1).cast("int"))
    c = F.col("user_id") % 5
    commands = e.select(F.col("event_type").alias("check_id"), key.alias("dedupe_key"), command.alias("command"), F.when(c == 0, "not_genuine").when(c == 4, "because").alias("reason_code"), F.lit("someone").alias("actor"), none.cast("string").alias("note"), F.when(c == 2, F.col("ts")).alias("until"), F.col("ts").alias("occurred_at"), F.lit("r2").alias("run_id"))
    after, _ = feedback.apply(commands, now, strict=False)
    return after.select(F.col("dedupe_key").cast("long").alias("finding"), "status", F.col("snoozed_until").isNotNull().alias("snoozed"))


@query("""WITH c AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
  k AS (SELECT user_id, count(*) AS n, max(value) FILTER (n = 2) AS v2, max(value) FILTER (n = 4) AS v4 FROM c GROUP BY user_id),
  s AS (SELECT *, CASE WHEN n = 1 OR n = 3 THEN 'draft' WHEN n = 2 THEN CASE WHEN v2 > 50 THEN 'active' ELSE 'draft' END WHEN v4 > 50 THEN 'active' WHEN n > 4 THEN 'rejected' ELSE 'draft' END AS status,
    (n >= 2 AND v2 <= 50)::INT + (n >= 4 AND v4 <= 50)::INT + CASE WHEN n > 4 THEN n - 4 - (v4 <= 50)::INT ELSE 0 END AS refused FROM k)
  SELECT 'check-' || user_id AS slug, status, CASE WHEN n >= 3 THEN 2 ELSE 1 END AS version, n AS commands, refused FROM s""")
def q_review_history(spark, sf_dir):
    """Checks under review: an addition, an approval, an amendment, an approval and rejections, as far as each one's commands go."""
    nth = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    c = table(spark, sf_dir, "events").withColumn("n", nth)
    command = F.when(F.col("n") == 1, "add").when(F.col("n").isin(2, 4), "approve").when(F.col("n") == 3, "amend").otherwise("reject")
    commands = c.select(F.concat(F.lit("check-"), "user_id").alias("slug"), F.col("n").alias("nth"), command.alias("command"), F.lit("{}").alias("document"), F.lit("why").alias("note"), F.lit("me").alias("actor"), (F.col("value") > 50).alias("passes"), F.col("ts").cast("timestamp_ntz").alias("occurred_at"))
    after, events = review.applied(commands, spark.createDataFrame([], review.REVIEWS))
    told = events.groupBy("slug").agg(F.count("*").alias("commands"), F.count_if(F.col("outcome") != "done").alias("refused"))
    return after.join(told, "slug").select("slug", "status", "version", "commands", "refused")


LAG_SQL = """WITH lag AS (SELECT practice AS practice_id, date_diff('day', schedule_date, invoice_date) AS value FROM appointments a JOIN invoices i ON i.appointment = a.id WHERE schedule_date IS NOT NULL),
  q AS (SELECT practice_id, count(*) AS n, quantile_cont(CAST(value AS DOUBLE), 0.95) AS learned FROM lag WHERE value IS NOT NULL GROUP BY practice_id)"""


@calibration.measure("appointment_to_invoice_lag")
def appointment_to_invoice_lag(v):
    a, i = v["clinic.appointments"], v["clinic.invoices"]
    return a.join(i, a["id"] == i["appointment"]).where("schedule_date IS NOT NULL").select(F.col("practice").alias("practice_id"), F.date_diff("invoice_date", "schedule_date").alias("value"))


@query(f"{LAG_SQL} SELECT practice_id, n, round(learned, 4) AS learned FROM q", *A_VIEWS)
def q_lag_percentile(spark, sf_dir):
    found = calibration.percentiles(appointment_to_invoice_lag(views(spark, sf_dir, *A_VIEWS)), 95)
    return found.withColumn("learned", F.round("learned", 4))


@query(f"""{LAG_SQL} SELECT n_nationkey AS practice_id, 'invoice_lag_days' AS param, coalesce(n, 0) AS n, CAST(n_nationkey AS VARCHAR) AS before,
  round(CASE WHEN coalesce(n, 0) >= 10 THEN learned ELSE 7 END, 4) AS after FROM nation LEFT JOIN q ON practice_id = n_nationkey WHERE n_nationkey % 6 <> 5""", *A_VIEWS)
def q_learn_params(spark, sf_dir):
    n = F.col("n_nationkey")
    config = table(spark, sf_dir, "nation").select(n.alias("practice_id"), F.create_map(F.lit("invoice_lag_days"), n.cast("string")).alias("params"), F.when(n % 6 == 5, "manual").otherwise("default").alias("params_source"))
    found = calibration.learned(checks.load("appointment-completed-no-invoice"), views(spark, sf_dir, *A_VIEWS), config)
    return found.withColumn("after", F.round("after", 4))


# --- profiling ---

def _profile_sql(name: str, columns: dict[str, str]) -> str:
    """SQL of column_stats with distinct counts."""
    parts = []
    for i, (c, kind) in enumerate(columns.items(), 1):
        shown = f"min({c})::VARCHAR, max({c})::VARCHAR"
        size = f"min(length(rtrim({c}))), max(length(rtrim({c}))), round(avg(length(rtrim({c}))), 4)" if kind == "string" else "NULL, NULL, NULL"
        parts.append(f"SELECT {i}, '{c}', count(*), count(*) - count({c}), round((count(*) - count({c})) / count(*), 6), count(DISTINCT {c}), {shown}, {size} FROM {name}")
    names = "position, column_name, rows, null_count, null_rate, distinct_count, min_value, max_value, min_length, max_length, avg_length"
    return f"SELECT * FROM ({' UNION ALL '.join(parts)}) t({names})"


@query(_profile_sql("orders", {"o_orderkey": "", "o_custkey": "", "o_orderstatus": "string", "o_orderpriority": "string"}))
def q_profile(spark, sf_dir):
    df = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    return profile.profile(df).select("position", "column_name", "rows", "null_count", "null_rate", "distinct_count", "min_value", "max_value", "min_length", "max_length", "avg_length")


NAMES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


@query(" UNION ALL ".join(f"SELECT '{n}' AS view, count(*) AS row_count, 'exact' AS status FROM {n}" for n in NAMES))
def q_rowcount(spark, sf_dir):
    return tables.row_counts({n: table(spark, sf_dir, n) for n in NAMES})


@query("SELECT 'c_name' AS column_name, min(length(rtrim(c_name))) AS min_length, max(length(rtrim(c_name))) AS max_length, round(avg(length(rtrim(c_name))), 4) AS avg_length FROM customer UNION ALL SELECT 'c_mktsegment', min(length(rtrim(c_mktsegment))), max(length(rtrim(c_mktsegment))), round(avg(length(rtrim(c_mktsegment))), 4) FROM customer")
def q_string_len(spark, sf_dir):
    return profile.column_stats(table(spark, sf_dir, "customer"), ["c_name", "c_mktsegment"]).select("column_name", "min_length", "max_length", "avg_length")


TOP_SQL = "SELECT '{0}' AS column_name, {0}::VARCHAR AS value, count(*) AS frequency, row_number() OVER (ORDER BY count(*) DESC, {0}::VARCHAR NULLS FIRST) AS rank FROM {1} GROUP BY {0}"


@query(" UNION ALL ".join(f"SELECT * FROM ({TOP_SQL.format(c, 'lineitem')}) WHERE rank <= 20" for c in ("l_returnflag", "l_suppkey")))
def q_topk(spark, sf_dir):
    return profile.top_values(profile.frequencies(table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_suppkey"]))


@query("SELECT 'l_partkey' AS column_name, l_partkey::VARCHAR AS value, count(*) AS frequency, row_number() OVER (ORDER BY count(*) DESC, l_partkey::VARCHAR) AS rank FROM lineitem GROUP BY l_partkey HAVING count(*) >= greatest(0.0001 * (SELECT count(*) FROM lineitem), 35) ORDER BY 4 LIMIT 20")
def q_topk_floor(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem")
    rows = df.count()
    return profile.top_values(profile.frequencies(df, ["l_partkey"]), 20, F.greatest(F.lit(0.0001 * rows), F.lit(35.0)))


@query("SELECT 'visitid' AS column_name, visitid::VARCHAR AS value, count(*) AS frequency, (SELECT count(*) FROM sentinels) AS rows FROM sentinels GROUP BY visitid HAVING count(*) >= 0.05 * (SELECT count(*) FROM sentinels) ORDER BY frequency DESC LIMIT 1", "clinic.sentinels")
def q_key_sentinel(spark, sf_dir):
    return sketches.key_sentinel(view(spark, sf_dir, "clinic.sentinels"), ["visitid"])


RARE_SQL = "SELECT '{0}' AS column_name, {0}::VARCHAR AS value, count(*) AS frequency, row_number() OVER (ORDER BY count(*) DESC, {0}::VARCHAR NULLS FIRST) AS rank FROM {1} GROUP BY {0} HAVING count(*) >= greatest(0.001 * (SELECT count(*) FROM {1}), 50)"


@query(" UNION ALL ".join(f"SELECT * FROM ({RARE_SQL.format(c, 'lineitem')}) WHERE rank <= 20" for c in ("l_orderkey", "l_suppkey", "l_returnflag", "l_linenumber", "l_shipdate")))
def q_topk_rare(spark, sf_dir):
    """What a profile shows of columns, unique ones too: values that enough rows have."""
    df = table(spark, sf_dir, "lineitem")
    found = sketches.heavy_values(df, ["l_orderkey", "l_suppkey", "l_returnflag", "l_linenumber", "l_shipdate"])
    return profile.top_values(found.where(F.col("frequency") >= profile.rare_floor(df.count())).drop("rows"))


@query("""SELECT column_name, (SELECT count(*) FROM lineitem) AS rows, 0::BIGINT AS null_count, least, most, true AS close FROM (
  SELECT 'l_orderkey' AS column_name, min(l_orderkey)::VARCHAR AS least, max(l_orderkey)::VARCHAR AS most FROM lineitem UNION ALL SELECT 'l_partkey', min(l_partkey)::VARCHAR, max(l_partkey)::VARCHAR FROM lineitem
  UNION ALL SELECT 'l_suppkey', min(l_suppkey)::VARCHAR, max(l_suppkey)::VARCHAR FROM lineitem UNION ALL SELECT 'l_returnflag', min(l_returnflag), max(l_returnflag) FROM lineitem UNION ALL SELECT 'l_shipdate', min(l_shipdate)::VARCHAR, max(l_shipdate)::VARCHAR FROM lineitem)""")
def q_profile_approximate(spark, sf_dir):
    """A profile for which the exact count had no time: distinct counts are within five hundredths of the true ones."""
    df = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_returnflag", "l_shipdate")
    found, status = sketches.profile_within(Source(spark, {"app.lineitem": df}), "app.lineitem", 600, Store(spark, _scratch(spark)), "r1", exact=False)
    true = profile.distinct_counts(df, df.columns).withColumnRenamed("distinct_count", "true_count")
    close = (F.abs(F.col("distinct_count") - F.col("true_count")) <= 0.05 * F.col("true_count")) & F.lit(status == "approximate")
    return found.join(true, "column_name").select("column_name", "rows", "null_count", F.col("min_value").alias("least"), F.col("max_value").alias("most"), close.alias("close"))


@query("SELECT count(*) AS n, sum(l_orderkey)::BIGINT AS total FROM lineitem WHERE l_orderkey % 10 = 0")
def q_sample_modulo(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem")
    where, _ = profile.sampling(df, 1_000_000)
    return df.where(where).agg(F.count("*").alias("n"), F.sum("l_orderkey").alias("total"))


@query("SELECT count(*) AS n, min(event_id) AS first FROM events WHERE ts >= TIMESTAMP '2024-01-30' - INTERVAL 2 DAY - INTERVAL 21 HOUR - INTERVAL 36 MINUTE")
def q_sample_watermark(spark, sf_dir):
    df = table(spark, sf_dir, "events").select("event_id", "event_type", "ts", F.col("user_id").alias("who"))
    df = df.withColumn("event_id", F.col("event_id").cast("double"))
    where, _ = profile.sampling(df, 1_000_000, "ts", (datetime(2024, 1, 1), datetime(2024, 1, 30)))
    return df.where(where).agg(F.count("*").alias("n"), F.min("event_id").cast("long").alias("first"))


@query(" UNION ALL ".join(f"SELECT '{t}' AS view, '{c}' AS column_name, count(DISTINCT {c}) AS distinct_count, count(*) AS rows FROM {t} HAVING count(*) > 0 AND count(DISTINCT {c}) = count(*)" for t, cs in {"customer": ("c_custkey", "c_name", "c_nationkey"), "nation": ("n_nationkey", "n_name", "n_regionkey"), "orders": ("o_orderkey", "o_custkey")}.items() for c in cs))
def q_candidate_key(spark, sf_dir):
    out = None
    for t, cs in {"customer": ["c_custkey", "c_name", "c_nationkey"], "nation": ["n_nationkey", "n_name", "n_regionkey"], "orders": ["o_orderkey", "o_custkey"]}.items():
        one = profile.candidate_keys(profile.profile(table(spark, sf_dir, t).select(*cs))).withColumn("view", F.lit(t))
        out = one if out is None else out.unionByName(one)
    return out


PAIR_TABLES = {"customer": ["c_custkey", "c_nationkey", "c_mktsegment"], "nation": ["n_nationkey", "n_regionkey"], "orders": ["o_orderkey", "o_custkey", "o_orderstatus"]}


@query("""WITH p(view, column_name, family) AS (VALUES ('customer', 'c_custkey', 'numeric'), ('customer', 'c_nationkey', 'numeric'), ('nation', 'n_nationkey', 'numeric'), ('nation', 'n_regionkey', 'numeric'), ('orders', 'o_orderkey', 'numeric'), ('orders', 'o_custkey', 'numeric'))
  SELECT a.view AS view_a, a.column_name AS column_a, b.view AS view_b, b.column_name AS column_b, 'evaluated' AS budget FROM p a JOIN p b ON a.view < b.view""")
def q_pair_prune(spark, sf_dir):
    out = None
    for t, cs in PAIR_TABLES.items():
        one = profile.profile(table(spark, sf_dir, t).select(*cs)).withColumn("view", F.lit(t))
        out = one if out is None else out.unionByName(one)
    return profile.eligible_pairs(out).where("view_a <> view_b")


PAIRS_ALL = {"customer": ("c_custkey", "c_nationkey", "c_name"), "nation": ("n_nationkey", "n_regionkey", "n_name"), "orders": ("o_orderkey", "o_custkey", "o_orderstatus")}


@query("WITH c AS (" + " UNION ALL ".join(f"SELECT '{t}' AS view, '{c}' AS column_name, '{'string' if c.endswith(('name', 'status')) else 'numeric'}' AS family, {str(c.endswith('key')).lower()} OR count(DISTINCT {c}) >= 0.5 * count(*) OR '{c}' LIKE '%id%' AS keyish FROM {t}" for t, cs in PAIRS_ALL.items() for c in cs) + """)
  SELECT a.view AS view_a, a.column_name AS column_a, b.view AS view_b, b.column_name AS column_b, 'evaluated' AS budget, (SELECT count(*) * (count(*) - 1) // 2 FROM c) AS considered
  FROM c a JOIN c b ON a.family = b.family AND (a.view < b.view OR a.view = b.view AND a.column_name < b.column_name) AND (a.keyish OR b.keyish)""")
def q_pairs_all(spark, sf_dir):
    """All column pairs worth a test, within a view too, beside how many there are before any is left out."""
    out = None
    for t, cs in PAIRS_ALL.items():
        one = profile.profile(table(spark, sf_dir, t).select(*cs)).withColumn("view", F.lit(t))
        out = one if out is None else out.unionByName(one)
    return profile.eligible_pairs(out).withColumn("considered", F.lit(profile.considered_pairs(out)).cast("long"))


@query("""WITH a AS (SELECT DISTINCT c_custkey AS v FROM customer), b AS (SELECT DISTINCT o_custkey AS v FROM orders), j AS (SELECT a.v AS x, b.v AS y FROM a FULL JOIN b ON a.v = b.v)
  SELECT count(x) AS distinct_a, count(y) AS distinct_b, count(*) FILTER (x IS NOT NULL AND y IS NOT NULL) AS common, count(x) - count(*) FILTER (x IS NOT NULL AND y IS NOT NULL) AS orphans_a,
    count(y) - count(*) FILTER (x IS NOT NULL AND y IS NOT NULL) AS orphans_b, round(count(*) FILTER (x IS NOT NULL AND y IS NOT NULL) / count(x), 6) AS containment_a, round(count(*) FILTER (x IS NOT NULL AND y IS NOT NULL) / count(y), 6) AS containment_b FROM j""")
def q_containment(spark, sf_dir):
    return profile.containment(table(spark, sf_dir, "customer"), "c_custkey", table(spark, sf_dir, "orders"), "o_custkey")


@query("""WITH v AS (SELECT DISTINCT 1 AS k, c_custkey AS x FROM customer UNION ALL SELECT DISTINCT 2, o_custkey FROM orders UNION ALL SELECT DISTINCT 3, c_nationkey FROM customer UNION ALL SELECT DISTINCT 4, n_nationkey FROM nation),
  p AS (SELECT a.k AS ka, b.k AS kb, count(*) AS common FROM v a JOIN v b USING (x) GROUP BY ALL), n AS (SELECT k, count(*) AS n FROM v GROUP BY k), name(k, c) AS (VALUES (1, 'customer.c_custkey'), (2, 'orders.o_custkey'), (3, 'customer.c_nationkey'), (4, 'nation.n_nationkey'))
  SELECT x.c AS a, y.c AS b, u.n AS distinct_a, w.n AS distinct_b, coalesce(p.common, 0) AS common FROM (VALUES (1, 2), (3, 4)) q(ka, kb) JOIN name x ON x.k = q.ka JOIN name y ON y.k = q.kb JOIN n u ON u.k = q.ka JOIN n w ON w.k = q.kb LEFT JOIN p ON p.ka = q.ka AND p.kb = q.kb""")
def q_containments(spark, sf_dir):
    t = {n: table(spark, sf_dir, n) for n in ("customer", "orders", "nation")}
    found = profile.containments(t, [("customer", "c_custkey", "orders", "o_custkey"), ("customer", "c_nationkey", "nation", "n_nationkey")])
    return found.select(F.concat_ws(".", "view_a", "column_a").alias("a"), F.concat_ws(".", "view_b", "column_b").alias("b"), "distinct_a", "distinct_b", "common")


RELATED = {"customer": ["c_custkey", "c_nationkey", "c_name"], "orders": ["o_orderkey", "o_custkey"], "nation": ["n_nationkey", "n_name"], "supplier": ["s_suppkey", "s_name"], "lineitem": ["l_orderkey", "l_partkey"]}
RELATED_PAIRS = [("orders", "o_custkey", "customer", "c_custkey"), ("customer", "c_nationkey", "nation", "n_nationkey"), ("lineitem", "l_orderkey", "orders", "o_orderkey"), ("customer", "c_name", "supplier", "s_name"), ("nation", "n_name", "customer", "c_name"), ("supplier", "s_suppkey", "lineitem", "l_partkey")]


def _related_sql(a: str, x: str, b: str, y: str) -> str:
    return f"""SELECT '{a}.{x}' AS a, '{b}.{y}' AS b, (SELECT count(DISTINCT {x}) FROM {a}) AS distinct_a, (SELECT count(DISTINCT {y}) FROM {b}) AS distinct_b,
  (SELECT count(*) FROM (SELECT {x} FROM {a} INTERSECT SELECT {y} FROM {b})) AS common"""


@query("WITH r AS (" + " UNION ALL ".join(_related_sql(*p) for p in RELATED_PAIRS) + """)
  SELECT a, b, CASE WHEN related THEN common END AS common, related, true AS within_bound FROM (SELECT *, common >= 0.5 * least(distinct_a, distinct_b) AS related FROM r)""")
def q_containment_budget(spark, sf_dir):
    """Relationships by sketches, counted exactly where half of a column's values may be in the other one."""
    source = Source(spark, {t: table(spark, sf_dir, t).select(*cs) for t, cs in RELATED.items()})
    found = sketches.containments_within(source, RELATED_PAIRS, 600, Store(spark, _scratch(spark)), "r1", lg_k=10)
    true = profile.containments(source.views, RELATED_PAIRS).select("view_a", "column_a", "view_b", "column_b", F.col("common").alias("true_common"))
    both = found.join(true, ["view_a", "column_a", "view_b", "column_b"])
    related = (F.col("status") == "exact") & (F.col("common") >= 0.5 * F.least("distinct_a", "distinct_b"))
    return both.select(F.concat_ws(".", "view_a", "column_a").alias("a"), F.concat_ws(".", "view_b", "column_b").alias("b"), F.when(related, F.col("common")).alias("common"), related.alias("related"), (F.abs(F.col("common") - F.col("true_common")) <= F.col("bound")).alias("within_bound"))


@query("SELECT 'ts' AS column_name, count(*) - count(ts) AS null_count, true AS fit, CAST(NULL AS VARCHAR) AS reason FROM events UNION ALL SELECT 'event_id', count(*) - count(event_id), false, 'wrong_type' FROM events")
def q_watermark_fitness(spark, sf_dir):
    return profile.watermark_fitness(table(spark, sf_dir, "events"), ["ts", "event_id"], EVENTS_AS_OF).select("column_name", "null_count", "fit", "reason")


def _sentinels(spark, sf_dir, kind):
    df = view(spark, sf_dir, "clinic.sentinels")
    stats = profile.profile(df)
    return profile.sentinels(stats, profile.top_values(profile.frequencies(df, ["visitid", "status", "channel"]))).where(F.col("sentinel_type") == kind)


@query("SELECT 'seen_at' AS column_name, 'placeholder_date' AS sentinel_type, '1900-01-01 00:00:00' AS value, CAST(NULL AS BIGINT) AS frequency FROM sentinels WHERE seen_at = TIMESTAMP '1900-01-01' LIMIT 1", "clinic.sentinels")
def q_sentinel_date(spark, sf_dir):
    return _sentinels(spark, sf_dir, "placeholder_date")


@query("SELECT 'visitid' AS column_name, 'zero_or_negative_id' AS sentinel_type, '0' AS value, count(*) AS frequency FROM sentinels WHERE visitid = 0", "clinic.sentinels")
def q_sentinel_id(spark, sf_dir):
    return _sentinels(spark, sf_dir, "zero_or_negative_id")


@query("SELECT 'status' AS column_name, 'empty_string_overload' AS sentinel_type, '' AS value, count(*) AS frequency FROM sentinels WHERE status = ''", "clinic.sentinels")
def q_sentinel_empty(spark, sf_dir):
    return _sentinels(spark, sf_dir, "empty_string_overload")


@query("SELECT 'channel' AS column_name, 'magic_value' AS sentinel_type, 'usual' AS value, count(*) AS frequency FROM sentinels WHERE channel = 'usual'", "clinic.sentinels")
def q_sentinel_magic(spark, sf_dir):
    return _sentinels(spark, sf_dir, "magic_value")


@query("SELECT 'isDummy' AS column_name, count(*) FILTER (toxic = 1) AS prevalence_count, round(count(*) FILTER (toxic = 1) / count(*), 6) AS prevalence_rate FROM labels")
def q_test_indicator(spark, sf_dir):
    return profile.test_indicators(table(spark, sf_dir, "labels").withColumnRenamed("toxic", "isDummy"))


def _archetype(spark, sf_dir, name):
    df = table(spark, sf_dir, name)
    f = profile.families(df)
    return profile.archetype(profile.profile(df), list(f), f).select(F.lit(name).alias("view"), "archetype", "name_column", "uniqueness")


@query("SELECT 'customer' AS view, 'reference' AS archetype, 'c_name' AS name_column, round(count(DISTINCT c_name) / count(*), 6) AS uniqueness FROM customer UNION ALL SELECT 'part', 'fact', 'p_name', round(count(DISTINCT p_name) / count(*), 6) FROM part UNION ALL SELECT 'orders', 'fact', 'o_orderpriority', round(count(DISTINCT o_orderpriority) / count(*), 6) FROM orders")
def q_archetype(spark, sf_dir):
    return _archetype(spark, sf_dir, "customer").unionByName(_archetype(spark, sf_dir, "part").where("name_column = 'p_name'")).unionByName(_archetype(spark, sf_dir, "orders"))


def _names_sql(name: str, key: str, strings: tuple[str, ...]) -> str:
    """A view's best name column and what follows from it; dated and linked columns it has none."""
    each = " UNION ALL ".join(f"SELECT {i} AS p, '{c}' AS name_column, round(count(DISTINCT {c}) / count(*), 6) AS uniqueness, count(*) AS n FROM {name}" for i, c in enumerate(strings))
    return f"SELECT '{name}' AS view, CASE WHEN uniqueness >= 0.95 THEN 'reference' ELSE 'fact' END AS archetype, name_column, uniqueness FROM ({each}) WHERE n > 0 ORDER BY uniqueness DESC, p LIMIT 1"


ARCHETYPES = {"part": ("p_partkey", ("p_name", "p_brand", "p_type")), "customer": ("c_custkey", ("c_name", "c_mktsegment")), "nation": ("n_nationkey", ("n_name",)), "supplier": ("s_suppkey", ("s_name",))}


@query(" UNION ALL ".join(f"SELECT * FROM ({_names_sql(n, k, cs)})" for n, (k, cs) in ARCHETYPES.items()))
def q_archetype_all(spark, sf_dir):
    """Archetypes of views with a key, whichever column names their rows best."""
    out = None
    for n, (k, cs) in ARCHETYPES.items():
        df = table(spark, sf_dir, n).select(k, *cs)
        f = profile.families(df)
        one = profile.archetype(profile.profile(df), list(f), f).select(F.lit(n).alias("view"), "archetype", "name_column", "uniqueness")
        out = one if out is None else out.unionByName(one)
    return out


@query("SELECT id AS key, name AS value FROM vocabulary ORDER BY id LIMIT 100", "clinic.vocabulary")
def q_reference_sample(spark, sf_dir):
    return profile.reference_sample(view(spark, sf_dir, "clinic.vocabulary"), "name", "id")


@query("SELECT right(name, CAST(strpos(reverse(name), '(') + 1 AS INTEGER)) AS tag, count(*) AS frequency FROM vocabulary WHERE name LIKE '%(%)' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20", "clinic.vocabulary")
def q_trailing_tag(spark, sf_dir):
    return profile.trailing_tags(view(spark, sf_dir, "clinic.vocabulary"), "name")


@query("""SELECT * FROM (VALUES ('l_orderkey', 'key'), ('l_partkey', 'key'), ('l_suppkey', 'key'), ('l_linenumber', 'categorical_coded'), ('l_returnflag', 'categorical_coded'), ('l_linestatus', 'categorical_coded'), ('l_extendedprice', 'measure'), ('l_shipdate', 'measure')) t(column_name, column_class)""")
def q_classify(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag", "l_linestatus", "l_extendedprice", "l_shipdate")
    return profile.profile(df).select("column_name", "column_class")


# --- metadata ---

@query("SELECT * FROM (VALUES ('app.events', 'VIEW', true), ('app.orders', 'VIEW', true)) t(view, kind, can_select)")
def q_surface(spark, sf_dir):
    return tables.surface(Source(spark, {"app.orders": table(spark, sf_dir, "orders"), "app.events": table(spark, sf_dir, "events")}))


@query("SELECT * FROM (VALUES ('nation', 1, 'n_nationkey', 'int'), ('nation', 2, 'n_name', 'string'), ('nation', 3, 'n_regionkey', 'int'), ('region', 1, 'r_regionkey', 'int'), ('region', 2, 'r_name', 'string')) t(view, position, column_name, data_type)")
def q_columns(spark, sf_dir):
    return tables.columns(spark, {n: table(spark, sf_dir, n) for n in ("nation", "region")})


DOCUMENTED = [("r_regionkey", "int"), ("R_NAME", "int"), ("r_comment", "string")]


@query("SELECT * FROM (VALUES ('r_comment', 'documented_missing_live'), ('r_name', 'type_mismatch')) t(column_name, discrepancy)")
def q_export_recon(spark, sf_dir):
    live = tables.columns(spark, {"region": table(spark, sf_dir, "region")})
    documented = spark.createDataFrame([("region", c, t) for c, t in DOCUMENTED], "view string, column_name string, data_type string")
    return reconcile.columns(documented, live).select("column_name", "discrepancy")


@query("SELECT * FROM (VALUES ('region', 'matched'), ('atlas', 'missing'), ('nation', 'extra')) t(view, status)")
def q_surface_recon(spark, sf_dir):
    exported = spark.createDataFrame([("REGION",), ("atlas",)], "view string")
    live = tables.columns(spark, {n: table(spark, sf_dir, n) for n in ("nation", "region")}).select("view").distinct()
    return reconcile.surface(exported, live)


@query("SELECT * FROM (VALUES ('book-recall', 'Book a recall'), ('verify-invoice', 'Verify invoice'), ('raise-recall-task', 'Raise recall task')) t(code, title)")
def q_actions(spark, sf_dir):
    return documents.actions(spark).where("code IN ('book-recall', 'verify-invoice', 'raise-recall-task')").select("code", "title")


@query("SELECT code, title, count(*) AS findings FROM events JOIN (VALUES " + ", ".join(f"({i}, '{c}', '{t}')" for i, (c, t, _) in enumerate(sorted(ACTIONS))) + """) a(i, code, title) ON user_id % 9 = i WHERE event_type <> 'error' GROUP BY ALL""")
def q_action_use(spark, sf_dir):
    """How many findings ask for each action of the library."""
    codes = F.array(*(F.lit(c) for c, *_ in sorted(ACTIONS)))
    asked = table(spark, sf_dir, "events").where("event_type <> 'error'").select(F.get(codes, (F.col("user_id") % 9).cast("int")).alias("code"))
    return asked.join(documents.actions(spark), "code").groupBy("code", "title").agg(F.count("*").alias("findings"))


@query("SELECT 'o_gone' AS column_name")
def q_drift(spark, sf_dir):
    gone = execute.drift(["o_orderkey", "o_gone", "O_CUSTKEY"], table(spark, sf_dir, "orders").columns)
    return spark.createDataFrame([(c,) for c in gone], "column_name string")


@query("SELECT event_type || '-' || (user_id % 7) AS slug FROM events GROUP BY 1 HAVING min(user_id % 7) > 2")
def q_persist_antijoin(spark, sf_dir):
    slugs = table(spark, sf_dir, "events").select(F.concat_ws("-", "event_type", (F.col("user_id") % 7).cast("string")).alias("slug"), (F.col("user_id") % 7).alias("k"))
    return registry.new_drafts(slugs.select("slug").distinct(), slugs.where("k <= 2").select("slug").distinct())


# --- dashboards ---

@query(f"{TWO_SQL} SELECT practice AS practice_id, count(*) FILTER (s1 = 'fail' AND s2 <> 'pass') AS open_findings, count(*) FILTER (s1 = 'fail' AND s2 = 'pass') AS resolved FROM both_runs WHERE s1 = 'fail' GROUP BY practice", *A_VIEWS)
def q_dash_status(spark, sf_dir):
    now = findings.snapshot(_second(spark, sf_dir)).where("first_seen_run = 'r1'")
    return dashboard.findings_by_practice(now).select(F.col("practice_id").cast("int").alias("practice_id"), F.col("open").alias("open_findings"), F.col("resolved_system").alias("resolved"))


@query("SELECT status, source, count(*) AS checks, count(DISTINCT practice_id) AS practices FROM (SELECT event_type AS check_id, user_id % 7 AS practice_id, CASE WHEN event_type = 'error' THEN 'draft' ELSE 'active' END AS status, CASE WHEN user_id % 2 = 0 THEN 'derived' ELSE 'manual' END AS source FROM events) GROUP BY status, source")
def q_dash_active(spark, sf_dir):
    e = table(spark, sf_dir, "events").select((F.col("user_id") % 7).alias("practice_id"), F.when(F.col("event_type") == "error", "draft").otherwise("active").alias("status"), F.when(F.col("user_id") % 2 == 0, "derived").otherwise("manual").alias("source"))
    return dashboard.checks_by_status(e, "practice_id")


@query("SELECT event_type AS check_id, event_id AS dedupe_key, ts AS occurred_at FROM events ORDER BY ts DESC, event_type, event_id LIMIT 20")
def q_dash_recent(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("check_id"), F.col("event_id").alias("dedupe_key"), F.col("ts").alias("occurred_at"))
    return dashboard.recent_events(e)


@query(f"{PRECISION_SQL} SELECT practice_id, check_id, precision FROM s ORDER BY precision, practice_id, check_id LIMIT 10", "clinic.feedback")
def q_dash_precision(spark, sf_dir):
    stats = calibration.precision(view(spark, sf_dir, "clinic.feedback")).withColumn("computed_at", F.lit(EVENTS_AS_OF))
    return dashboard.lowest_precision(stats).select("practice_id", "check_id", "precision")


@query("SELECT user_id % 7 AS practice_id, count(*) FILTER (user_id % 4 = 0) AS open, count(*) FILTER (user_id % 4 = 2) AS acknowledged, count(*) FILTER (user_id % 4 = 1) AS dismissed, count(*) FILTER (user_id % 4 = 3) AS resolved_system FROM events GROUP BY 1")
def q_dash_practices(spark, sf_dir):
    old = F.element_at(F.array(*map(F.lit, ("open", "dismissed", "acknowledged", "resolved_system"))), (F.col("user_id") % 4 + 1).cast("int"))
    return dashboard.findings_by_practice(table(spark, sf_dir, "events").select((F.col("user_id") % 7).alias("practice_id"), old.alias("status")))


@query(A_SQL.format(as_of="2001-12-31", lag=7).replace("SELECT id, practice, patient, schedule_date, ", "SELECT practice AS practice_id, count(*) AS n, 'Appointment ' || min(id) || ' on ' || strftime(min(schedule_date), '%Y-%m-%d') || ' has no invoice.' AS text FROM (SELECT id, practice, patient, schedule_date, ") + ") WHERE tri_state = 'fail' GROUP BY practice", *A_VIEWS)
def q_render(spark, sf_dir):
    fails = _judged(spark, sf_dir, "appointment-completed-no-invoice").where("tri_state = 'fail'").groupBy(F.col("practice").alias("practice_id")).agg(F.count("*").alias("n"), F.min("id").alias("id"), F.min("schedule_date").alias("day"))
    values = fails.withColumn("fields", F.create_map(F.lit("id"), F.col("id").cast("string"), F.lit("day"), F.date_format("day", "yyyy-MM-dd")))
    return values.select("practice_id", "n", narrate.rendered("Appointment {{ id }} on {{day}} has no invoice.", "fields", ("id", "day")).alias("text"))


@query(narrate.SUSPECT_SQL)
def q_suspect_tokens(spark, sf_dir):
    return narrate.suspect_tokens(table(spark, sf_dir, "documents"), "doc_id", "text").groupBy("doc_id", "kind").agg(F.count("*").alias("n"))


#: A right template, one that names a hidden field, one with a number of its own, one with a lost field, and one that isn't rendered truly.
TEMPLATES = ("Appointment {{ id }} on {{day}} has no invoice.", "Appointment {{ id }} of {{ who }}", "Appointment {{ id }} on {{day}} has no invoice after 7 days", "Appointment {{ lost }}", "Appointment {{ id }}")


@query("""SELECT id, i AS nth, CASE id % 5 WHEN 1 THEN 'undeclared_evidence_field' WHEN 2 THEN 'unallowlisted_token' WHEN 3 THEN 'unresolvable_placeholder' ELSE CASE i WHEN 0 THEN 'rendered_text_mismatch' END END AS rule,
    CASE id % 5 WHEN 1 THEN 'who' WHEN 2 THEN 'numeric ''7'' at ' || length('Appointment ' || id || ' on ' || coalesce(strftime(schedule_date, '%Y-%m-%d'), 'None') || ' has no invoice after ') WHEN 3 THEN 'lost' ELSE 'the text isn''t what the template renders to' END AS detail
  FROM appointments, (VALUES (0)) t(i) WHERE id % 5 > 0""", "clinic.appointments")
def q_narrative_violations(spark, sf_dir):
    """What is wrong with each narrative of all appointments, a row a violation."""
    a = view(spark, sf_dir, "clinic.appointments")
    kind = (F.col("id") % 5).cast("int")
    day = F.coalesce(F.date_format("schedule_date", "yyyy-MM-dd"), F.lit("None"))
    said = F.when(kind == 0, F.concat(F.lit("Appointment "), "id", F.lit(" on "), day, F.lit(" has no invoice."))).when(kind == 1, F.concat(F.lit("Appointment "), "id", F.lit(" of "), F.col("patient").cast("string")))
    said = said.when(kind == 2, F.concat(F.lit("Appointment "), "id", F.lit(" on "), day, F.lit(" has no invoice after 7 days"))).otherwise(F.concat(F.lit("Appointment no. "), "id"))
    none = F.array().cast("array<string>")
    rows = a.select("id", F.get(F.array(*map(F.lit, TEMPLATES)), kind).alias("template"), said.alias("text"), F.create_map(F.lit("id"), F.col("id").cast("string"), F.lit("day"), day, F.lit("who"), F.col("patient").cast("string")).alias("evidence"), F.create_map().cast("map<string,string>").alias("params"), F.array(F.lit("id"), F.lit("day")).alias("declared"), none.alias("actions"), none.alias("selected"), none.alias("vocabulary"))
    # Outer: otherwise the optimizer asks for rows with violations below the join, and judges each row there as well.
    return narrate.violations(rows).select("id", F.posexplode_outer("violations").alias("nth", "v")).where("nth IS NOT NULL").select("id", "nth", "v.rule", "v.detail")


@query("SELECT event_type AS check_version, CASE WHEN value > 50 THEN 'a:double' ELSE 'b:string' END AS shape, count(*) AS findings FROM events GROUP BY ALL")
def q_template_groups(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("check_version"), F.when(F.col("value") > 50, "a:double").otherwise("b:string").alias("shape"))
    return narrate.template_groups(rows)


class _Echo:
    """Writes the template that is told for a check's title, and counts how often it was asked."""

    def __init__(self, templates):
        self.templates, self.asked = templates, 0

    def complete(self, prompt):
        self.asked += 1
        return '{"template": "' + next(t for title, t in self.templates.items() if title in prompt) + '", "actions": []}'


@query("""SELECT CASE WHEN schedule_date IS NULL THEN 'id:int' ELSE 'day:date,id:int' END AS shape, CASE WHEN schedule_date IS NULL THEN 'blocked_fallback' ELSE 'valid' END AS status, count(*) AS findings,
  min(CASE WHEN schedule_date IS NULL THEN 'Finding ' || id ELSE 'Appointment ' || id || ' on ' || strftime(schedule_date, '%Y-%m-%d') END) AS first, CASE WHEN schedule_date IS NULL THEN 2 ELSE 1 END AS asked, 0 AS asked_again FROM appointments GROUP BY ALL""", "clinic.appointments")
def q_template_cache(spark, sf_dir):
    """Narratives of all appointments in two runs, the second of which asks for no template."""
    check, store = checks.load("appointment-completed-no-invoice"), Store(spark, _scratch(spark))
    a = view(spark, sf_dir, "clinic.appointments")
    day, number = F.date_format("schedule_date", "yyyy-MM-dd"), F.col("id").cast("string")
    dated = F.col("schedule_date").isNotNull()
    rows = a.select("id", F.lit("v1").alias("check_version"), F.when(dated, "day:date,id:int").otherwise("id:int").alias("shape"), F.when(dated, F.create_map(F.lit("id"), number, F.lit("schedule_date"), day)).otherwise(F.create_map(F.lit("id"), number)).alias("evidence"), F.create_map().cast("map<string,string>").alias("params"))
    client = _Echo({check.title: "Appointment {{ id }} on {{ schedule_date }}"})
    compose.templates(rows, {"v1": check}, client, store)
    first = client.asked
    compose.templates(rows, {"v1": check}, client, store)
    kept = store.read("templates", compose.TEMPLATES)
    told = compose.composed(rows, {"v1": check}, kept, "Finding {{ id }}")
    counted = told.groupBy("shape", F.col("narrative_status").alias("status")).agg(F.count("*").alias("findings"), F.min("text").alias("first"))
    return counted.join(kept.select("shape", "asked"), "shape").withColumn("asked_again", F.lit(client.asked - first))


@query(drafts_sql(AS_OF.isoformat(sep=" ")), *DRAFT_VIEWS)
def q_drafts(spark, sf_dir):
    from plumbline.operators import drafts

    catalog = drafts.catalog(spark, views(spark, sf_dir, *DRAFT_VIEWS), as_of=AS_OF)
    return spark.createDataFrame([(d["id"], d["title"], d["category"], d["entity"]["view"]) for d in drafts.generate(catalog, as_of=AS_OF, practice_column={"clinic.invoices": "supplier"})], "slug string, title string, category string, view string")
