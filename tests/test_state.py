from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from plumbline import checks
from plumbline.functions.canonical import dedupe_key, key_json
from plumbline.operators import calibration, feedback, findings
from plumbline.operators.run import Plan, executions, history, run, runs
from plumbline.sources import tables
from plumbline.sources.guard import Source
from plumbline.sources.state import Store
from plumbline.streaming.checks import start

ROWS = "check_id string, practice_id string, entity_key string, tri_state string, evidence string"
NOW = datetime(2024, 6, 30)


def upsert(spark, before, rows, run_id, **options):
    changes = findings.transitions(spark.createDataFrame([("c", "1", k, s, f"{s}-{run_id}") for k, s in rows], ROWS), before, run_id, **options)
    got = {r["entity_key"]: (r["status"], r["event"], r["stat"], r["last_seen_run"], r["evidence"]) for r in changes.collect()}
    return findings.snapshot(changes), got


def test_every_transition(spark):
    empty = spark.createDataFrame([], findings.FINDINGS)
    one, got = upsert(spark, empty, [("a", "fail"), ("b", "pass"), ("c", "indeterminate"), ("d", "fail")], "r1")
    assert got["a"] == ("open", "created", "created", "r1", "fail-r1") and got["b"][2] is None and one.count() == 2
    same, got = upsert(spark, one, [("a", "fail"), ("d", "pass")], "r1")
    assert got["a"][1:3] == (None, "skipped_idempotent") and got["d"][0] == "open" and got["d"][2] == "skipped_idempotent"
    two, got = upsert(spark, same, [("a", "pass"), ("d", "indeterminate")], "r2")
    assert got["a"] == ("resolved_system", "resolved_system", "resolved_system", "r2", "fail-r1") and got["d"] == ("open", None, None, "r1", "fail-r1")
    three, got = upsert(spark, two, [("a", "fail"), ("d", "fail")], "r3")
    assert got["a"] == ("open", "reseen", "reopened", "r3", "fail-r3") and got["d"][2] == "reseen"
    dismissed = three.withColumn("status", F.lit("dismissed"))
    _, got = upsert(spark, dismissed, [("a", "fail"), ("d", "pass")], "r4")
    assert got["a"][:3] == ("dismissed", "reseen", "reseen") and got["d"][:3] == ("dismissed", None, None)
    _, got = upsert(spark, three, [("a", "pass")], "r5", auto_resolve=False)
    assert got["a"][0] == "open" and got["d"][3] == "r3"  # no row: untouched


def test_rows_of_one_key_count_as_one(spark):
    _, got = upsert(spark, spark.createDataFrame([], findings.FINDINGS), [("a", "pass"), ("a", "fail"), ("a", "indeterminate")], "r1")
    assert got["a"][2] == "created"


def test_golden_dedupe_key(spark):
    want = "efafdcc9f9b5e0fc6dd34127270cb225f597deafa21c50e8d5d6406efaff4c65"
    got = spark.sql("SELECT 'x' AS b, 7 AS id").select(findings.dedupe_key(F.lit("c"), key_json(["id", "b"])).alias("k")).first()["k"]
    assert got == dedupe_key("c", {"id": 7, "b": "x"}) == want


def test_feedback(spark):
    now, _ = upsert(spark, spark.createDataFrame([], findings.FINDINGS), [("a", "fail"), ("b", "fail")], "r1")
    keys = {r["entity_key"]: r["dedupe_key"] for r in now.collect()}

    def commands(*rows):
        return spark.createDataFrame([("c", keys.get(k, "?"), command, reason, "me", None, until, NOW, "r2") for k, command, reason, until in rows], feedback.COMMANDS)

    after, events = feedback.apply(commands(("a", "dismiss", "not_genuine", None), ("b", "snooze", None, NOW)), now)
    assert {r["entity_key"]: r["status"] for r in after.collect()} == {"a": "dismissed", "b": "open"} and events.count() == 2
    again, _ = feedback.apply(commands(("a", "reopen", None, None), ("b", "reopen", None, None)), after)
    assert again.where("status = 'open' AND snoozed_until IS NULL").count() == 2
    for bad in (("a", "dismiss", "because", None), ("a", "reopen", None, None), ("z", "dismiss", "not_genuine", None), ("a", "shout", None, None), ("a", "snooze", None, None)):
        with pytest.raises(feedback.FeedbackError):
            feedback.apply(commands(bad), now)


def test_precision_and_demotion(spark):
    rows = [(1, "bad", "genuine_issue" if i < 3 else "not_genuine", NOW + timedelta(hours=i), i) for i in range(15)]
    rows += [(1, "good", "genuine_issue" if i < 13 else "not_genuine", NOW + timedelta(hours=i), i) for i in range(15)]
    rows += [(1, "few", "not_genuine", NOW, i) for i in range(9)]
    d = spark.createDataFrame(rows, "practice_id int, check_id string, reason_code string, occurred_at timestamp_ntz, event_id int")
    got = {r["check_id"]: r["precision"] for r in calibration.precision(d).collect()}
    assert got == {"bad": 0.2, "good": round(13 / 15, 6)}
    assert calibration.precision(d, window=12).where("check_id = 'bad'").first()["genuine"] == 0
    stats = calibration.precision(d).withColumn("computed_at", F.lit(NOW))
    config = spark.createDataFrame([(1, "good", False, None, None)], "practice_id int, check_id string, demoted boolean, demoted_at timestamp, demotion_reason string")
    found = calibration.demotions(stats, config)
    assert [r["check_id"] for r in found.collect()] == ["bad"]
    after = calibration.demoted(config, found, NOW)
    assert {r["check_id"]: r["demoted"] for r in after.collect()} == {"good": False, "bad": True}
    assert calibration.demotions(stats, after).count() == 0


def test_learned_parameters(spark):
    import plumbline.queries  # noqa: F401  registers the measure

    values = spark.createDataFrame([(1, float(i)) for i in range(1, 11)] + [(2, 1.0)], "practice_id int, value double")
    got = {r["practice_id"]: r["learned"] for r in calibration.percentiles(values, 50).collect()}
    assert got[1] == 5.5
    config = spark.createDataFrame([(1, {"a": "1", "p": "999"}, "default"), (2, {"p": "2"}, "manual")], "practice_id int, params map<string,string>, params_source string")
    changes = spark.createDataFrame([(1, "p", 10, "999", 5.5)], "practice_id int, param string, n long, before string, after double")
    after = {r["practice_id"]: (r["params"], r["params_source"]) for r in calibration.merged(config, changes).collect()}
    assert after == {1: ({"a": "1", "p": "5.5"}, "learned"), 2: ({"p": "2"}, "manual")}
    assert calibration.params_of({"a": "1.5", "b": "x"}) == {"a": 1.5, "b": "x"}


def views(spark, completed=1):
    a = spark.createDataFrame([(1, 1, datetime(2024, 1, 1), completed, "x", 0, 100), (2, 1, datetime(2024, 1, 1), 0, "x", 0, 100)], "id int, patient int, schedule_date timestamp_ntz, completed int, status string, is_deleted int, practice int")
    return {"clinic.appointments": a, "clinic.invoices": spark.createDataFrame([], "appointment int, line int, part int, supplier int, invoice_date timestamp_ntz, active int, total decimal(18,2)")}


def test_runs_are_idempotent_and_skip_drift(spark, tmp_path):
    store, chosen = Store(spark, f"file://{tmp_path}/state"), [checks.load("appointment-completed-no-invoice"), checks.load("appointment-unknown-status")]
    source = Source(spark, views(spark))
    first = run(source, store, chosen, run_id="r1", as_of=NOW)
    assert first.stats["created"] == 3 and "| appointment-unknown-status | 100 | 2 | 2 | 0 | 0 |" in first.markdown()
    again = run(source, store, chosen, run_id="r1", as_of=NOW)
    assert again.stats == {"skipped_idempotent": 3} and store.read("findings", findings.FINDINGS).count() == 3
    later = run(Source(spark, views(spark, 0)), store, chosen, run_id="r2", as_of=NOW)
    assert later.stats["resolved_system"] == 1 and history(store).where("run_id = 'r2'").count() == 3
    drifted = run(source, store, chosen, run_id="r3", as_of=NOW, pinned={"clinic.appointments": ["id", "gone"]})
    assert drifted.skipped_drift == {c.id: ["gone"] for c in chosen}


def test_a_repeated_run_keeps_its_events(spark, tmp_path):
    store, chosen = Store(spark, f"file://{tmp_path}/state"), [checks.load("appointment-completed-no-invoice"), checks.load("appointment-unknown-status")]
    source = Source(spark, views(spark))
    first = run(source, store, chosen, run_id="r1", as_of=NOW, trigger="nightly")
    told = sorted(map(tuple, history(store).collect()), key=str)
    assert len(told) == 3
    run(source, store, chosen, run_id="r1", as_of=NOW)
    assert sorted(map(tuple, history(store).collect()), key=str) == told and store.version("findings") == 1
    one = runs(store).first()
    assert (one["run_id"], one["trigger"], one["status"], one["checks"], one["errors"]) == ("r1", "nightly", "completed", 2, 0) and one["ended_at"] >= one["started_at"]
    assert first.expensive()[0][0] == "clinic.appointments" and executions(store).where("duration_ms > 0 AND status = 'ok'").count() == 2


@pytest.mark.parametrize("part", ["events", "findings", "ended"])
def test_a_run_that_broke_off_is_taken_up(spark, tmp_path, monkeypatch, part):
    root = f"file://{tmp_path}/state"
    store, chosen, source = Store(spark, root), [checks.load("appointment-unknown-status")], Source(spark, views(spark))
    write, append = Store.write, Store.append

    def stopping(method):
        def call(self, name, *rest, **more):
            if name == part:
                raise RuntimeError("the machine is gone")
            return method(self, name, *rest, **more)

        return call

    monkeypatch.setattr(Store, "write", stopping(write))
    monkeypatch.setattr(Store, "append", stopping(append))
    with pytest.raises(RuntimeError):
        run(source, store, chosen, run_id="r1", as_of=NOW)
    assert runs(store).first()["status"] == "running"
    monkeypatch.undo()
    assert run(source, store, chosen, run_id="r1", as_of=NOW).stats["created"] == 2
    assert store.version("findings") == 1 and history(store).count() == 2 and runs(store).first()["status"] == "completed"


def test_plans_of_views(spark, tmp_path):
    store, check = Store(spark, f"file://{tmp_path}/state"), checks.load("appointment-unknown-status")
    source, view = Source(spark, views(spark)), "clinic.appointments"
    r = run(source, store, [check], run_id="r1", as_of=NOW, plans={view: Plan(trailing_column="schedule_date", trailing_days=3650, hot=True)})
    assert r.strategies == {view: "trailing"} and r.executions[0]["n_examined"] == 2 and len(r.asks) == 1 and "Ask: clinic.appointments" in r.markdown()
    assert run(source, store, [check], run_id="r2", as_of=NOW, plans={view: Plan(trailing_column="schedule_date", trailing_days=1)}).executions == []
    keyed = {view: Plan(key=("id",))}
    assert run(source, store, [check], run_id="r3", as_of=NOW, plans=keyed).strategies == {view: "full_scan"}
    assert run(source, store, [check], run_id="r4", as_of=NOW, plans=keyed).strategies == {view: "unchanged"}
    fewer = Source(spark, views(spark) | {view: views(spark)[view].limit(1)})
    assert run(fewer, store, [check], run_id="r5", as_of=NOW, plans=keyed).strategies == {view: "full_scan"}


def test_scans_that_take_too_long(spark, tmp_path, monkeypatch):
    source = Source(spark, views(spark))
    long = spark.range(0, 1 << 40, 1, 4).selectExpr("hash(id) % 9 AS k").groupBy("k").count()
    assert source.within(1, long.collect) is None and source.within(60, spark.range(5).count) == 5
    assert tables.counted(source, "clinic.appointments", 60) == (2, "exact")
    spark.range(7).write.parquet(f"{tmp_path}/t")
    assert tables.footer_rows(spark.read.parquet(f"{tmp_path}/t")) == 7 and tables.footer_rows(spark.range(7).toDF("id")) is None
    monkeypatch.setattr(Source, "within", lambda self, seconds, job: None)
    filed = Source(spark, {"t.v": spark.read.parquet(f"{tmp_path}/t")})
    assert tables.counted(filed, "t.v", 1) == (7, "approximate") and tables.counted(source, "clinic.appointments", 1) == (None, "indeterminate")
    r = run(source, Store(spark, f"file://{tmp_path}/state"), [checks.load("appointment-unknown-status")], run_id="r1", as_of=NOW, timeout_s=2)
    assert r.status == "completed_with_errors" and "took more than" in r.errors["appointment-unknown-status"]


def test_one_writer_gets_a_version(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    assert store._claim(f"{store.root}/t/_claims/1") and not store._claim(f"{store.root}/t/_claims/1")
    assert store.write("t", spark.range(1)) == 2 and store.version("t") == 2


def test_dismissals_of_events(spark):
    events = spark.createDataFrame([("c", "k1", "dismissed", "not_genuine", NOW, "r1"), ("c", "k1", "created", None, NOW, "r0"), ("c", "k2", "dismissed", None, NOW, "r1")], "check_id string, dedupe_key string, event string, reason_code string, occurred_at timestamp_ntz, run_id string")
    known = spark.createDataFrame([("c", "k1", "7"), ("c", "k2", "8")], "check_id string, dedupe_key string, practice_id string")
    assert [tuple(r)[:3] for r in calibration.dismissals(events, known).collect()] == [("7", "c", "not_genuine")]


def test_watermarked_views_advance(spark, tmp_path):
    store, check = Store(spark, f"file://{tmp_path}/state"), checks.load("appointment-unknown-status")
    source = Source(spark, views(spark))
    r = run(source, store, [check], run_id="r1", as_of=NOW, watermarks={"clinic.appointments": "schedule_date"})
    assert r.strategies == {"clinic.appointments": "increment"} and r.executions[0]["n_examined"] == 2
    r = run(source, store, [check], run_id="r2", as_of=NOW, watermarks={"clinic.appointments": "schedule_date"})
    assert r.executions == []


def test_store_reads_complete_versions_only(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    assert store.read("t", "a int").count() == 0
    for n in (1, 2, 3):
        assert store.write("t", spark.range(n).selectExpr("cast(id as int) a")) == n
    (tmp_path / "s/t/v=9").mkdir()
    assert store.version("t") == 3 and store.read("t", "a int").count() == 3 and not (tmp_path / "s/t/v=1").exists()


def test_stream_of_rows(spark, tmp_path):
    v = views(spark)
    v["clinic.appointments"].write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(v["clinic.appointments"].schema).parquet(f"{tmp_path}/in")
    store = Store(spark, f"file://{tmp_path}/state")
    start(stream, "clinic.appointments", {"clinic.invoices": v["clinic.invoices"]}, [checks.load("appointment-unknown-status")], store, as_of=NOW, checkpoint=f"{tmp_path}/cp").awaitTermination()
    assert store.read("findings", findings.FINDINGS).where("check_id = 'appointment-unknown-status'").count() == 2


def test_dashboard(spark):
    from plumbline.operators import dashboard

    config = spark.createDataFrame([(1, "c", True, "low"), (2, "c", False, None)], "practice_id int, check_id string, demoted boolean, demotion_reason string")
    checks_ = spark.createDataFrame([("c", "A check", "active", "manual")], "check_id string, title string, status string, source string")
    assert [tuple(r) for r in dashboard.demoted_pairs(config, checks_).collect()] == [(1, "c", "A check", "low")]
    assert dashboard.checks_by_status(checks_).first()["checks"] == 1
    runs = spark.createDataFrame([("r1", "c", 5, 1), ("r2", "c", 6, 2), ("r2", "d", 1, 0)], "run_id string, check_id string, n_examined long, n_fail long")
    assert [tuple(r) for r in dashboard.last_runs(runs, 1).collect()] == [("r2", 7, 2, 2)]
