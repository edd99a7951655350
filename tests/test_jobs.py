"""Reviewers' commands, precision, demotion, recalibration and verification over state tables."""

import json
from datetime import datetime, timedelta

import pytest

from plumbline.__main__ import main
from plumbline.operators import calibration, feedback, findings, jobs
from plumbline.operators.run import EXECUTIONS, history, run
from plumbline.plans.document import from_dict
from plumbline.sources.guard import Source
from plumbline.sources.state import Store

VIEW, NOW = "app.rows", datetime(2024, 6, 30)


def document(name="slow", params=None, predicate="value < 0"):
    return {"id": name, "title": "t", "category": "workflow", "default_severity": "low", "entity": {"view": VIEW, "key": ["id"], "practice_column": "practice", "base_filters": []}, "params": params or {}, "prerequisites": [], "predicate": predicate, "evidence": ["id", "value"], "actions": ["correct-record"], "resolution": "r"}


def found(spark, store, n=40):
    """A store with findings of two practices, a run's."""
    df = spark.range(n).selectExpr("CAST(id AS int) AS id", "CAST(id % 2 AS int) AS practice", "-1.0D AS value")
    run(Source(spark, {VIEW: df}), store, [from_dict(document())], run_id="r1", as_of=NOW)
    return store.read("findings", findings.FINDINGS)


def dismissals(spark, rows, genuine):
    at = [(r["check_id"], r["dedupe_key"], "dismiss", "genuine_issue" if genuine(r) else "not_genuine", "someone", None, None, NOW + timedelta(seconds=i)) for i, r in enumerate(rows)]
    return spark.createDataFrame(at, ", ".join(c for c in feedback.COMMANDS.split(", ") if not c.startswith("run_id")))


def test_the_loop_from_dismissals_to_a_demotion(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    rows = sorted(found(spark, store).collect(), key=lambda r: r["dedupe_key"])
    commands = dismissals(spark, rows, lambda r: r["practice_id"] == "1")
    for _ in range(2):
        assert jobs.review(store, commands, "b1").where("event = 'dismissed'").count() == 40
    assert store.version("findings") == 2 and history(store).where("event = 'dismissed'").count() == 40
    assert {r["status"] for r in store.read("findings", findings.FINDINGS).collect()} == {"dismissed"}
    got = {r["practice_id"]: (r["n"], r["genuine"], r["precision"]) for r in jobs.precision(store, "p1", NOW).collect()}
    assert got == {"0": (20, 0, 0.0), "1": (20, 20, 1.0)}
    assert [r["practice_id"] for r in jobs.demote(store, "d0", NOW, dry_run=True).collect()] == ["0"] and jobs.config(store).count() == 0
    for _ in range(2):
        assert [r["practice_id"] for r in jobs.demote(store, "d1", NOW).collect()] == ["0"]
    assert jobs.demote(store, "d2", NOW).count() == 0
    assert [(r["practice_id"], r["demoted"], r["demoted_at"], r["demotion_reason"]) for r in jobs.config(store).collect()] == [("0", True, NOW, "precision 0.0000 below floor 0.3000")]


def test_wrong_commands_leave_everything_as_it_was(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    rows = found(spark, store, 4).collect()
    commands = dismissals(spark, rows, lambda r: True)
    bad = commands.selectExpr("check_id", "dedupe_key", "command", "IF(actor IS NULL, reason_code, 'because') AS reason_code", "actor", "note", "until", "occurred_at")
    with pytest.raises(feedback.FeedbackError):
        jobs.review(store, bad, "b1")
    assert store.version("findings") == 1 and not store.has("events", "b1")
    assert jobs.review(store, bad.unionByName(commands.limit(0)), "b2", strict=False).count() == 0


def test_a_job_that_is_overtaken_is_made_anew(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    rows = sorted(found(spark, store, 4).collect(), key=lambda r: r["dedupe_key"])

    class Overtaken(Store):
        """Another batch lands between this one's reading and its writing."""

        def write(self, name, df, *rest, **more):
            if name == "findings" and not any(v.by == "first" for v in store.versions("findings")):
                jobs.review(store, dismissals(spark, rows[:2], lambda r: True), "first")
            return super().write(name, df, *rest, **more)

    jobs.review(Overtaken(spark, str(tmp_path)), dismissals(spark, rows[2:], lambda r: True), "second")
    assert {r["status"] for r in store.read("findings", findings.FINDINGS).collect()} == {"dismissed"}
    assert history(store).where("event = 'dismissed'").count() == 4


def test_recalibration(spark, tmp_path):
    calibration.MEASURES["test_lag"] = lambda v: v[VIEW].selectExpr("practice AS practice_id", "value")
    try:
        check = from_dict(document(params={"days": {"type": "integer", "default": {"strategy": "percentile", "measure": "test_lag", "p": 50, "fallback": 7}}}, predicate="value > {days}"))
        fixed = from_dict(document("plain"))
        store = Store(spark, str(tmp_path))
        views = {VIEW: spark.range(60).selectExpr("CAST(id AS int) AS id", "CAST(IF(id < 55, id % 2, 2) AS int) AS practice", "CAST(id AS double) AS value")}
        store.append("executions", spark.createDataFrame([(c, str(p), 1, 0, 1, 0, 0.0, "full_scan", 1.0, "ok", None) for c in ("slow", "plain") for p in range(3)], EXECUTIONS), "r1")
        manual = [("0", "slow", {"days": "3"}, "manual", None, None, None)]
        store.write("check_config", spark.createDataFrame(manual, jobs.CONFIG))
        want = {("0", None, "3.0", False), ("1", 27, "None", True), ("2", 5, "None", True)}
        show = lambda df: {(r["practice_id"], r["n"], str(float(r["before"])) if r["before"] else "None", r["applied"]) for r in df.collect()}
        assert show(jobs.recalibrate(store, views, [check, fixed], "c0", dry_run=True)) == want and store.version("check_config") == 1
        for _ in range(2):
            assert show(jobs.recalibrate(store, views, [check, fixed], "c1")) == want
        after = {r["practice_id"]: (r["params"], r["params_source"]) for r in jobs.config(store).collect()}
        assert after == {"0": ({"days": "3"}, "manual"), "1": ({"days": "27.0"}, "learned"), "2": ({"days": "7.0"}, "learned")}
        assert store.version("check_config") == 2
        assert jobs.recalibrate(store, views, [fixed], "c2").count() == 0 and jobs.config(store).count() == 3
    finally:
        del calibration.MEASURES["test_lag"]


def test_commands(spark, tmp_path, capsys):
    state = tmp_path / "state"
    rows = found(spark, Store(spark, str(state)), 24).collect()
    spark.range(5).selectExpr("CAST(id AS int) AS id", "1 AS practice", "1.0D AS value").write.parquet(f"{tmp_path}/v")
    base = ["--views", f"{VIEW}={tmp_path}/v", "--state", str(state), "--as-of", "2024-06-30"]
    lines = [json.dumps({"check_id": r["check_id"], "dedupe_key": r["dedupe_key"], "command": "dismiss", "reason_code": "not_genuine", "actor": "x", "occurred_at": "2024-07-01T00:00:00"}) for r in rows]
    (tmp_path / "c.jsonl").write_text("\n".join(lines))
    assert main(["feedback", *base, "--commands", str(tmp_path / "c.jsonl"), "--run-id", "b1"]) == 0 and main(["precision", *base]) == 0
    capsys.readouterr()
    assert main(["demote", *base]) == 0
    assert [json.loads(x)["practice_id"] for x in capsys.readouterr().out.splitlines()] == ["0", "1"]
    (tmp_path / "bad.jsonl").write_text(lines[0].replace("dismiss", "praise"))
    assert main(["feedback", *base, "--commands", str(tmp_path / "bad.jsonl")]) == 1
    (tmp_path / "names").write_text(f"{VIEW}\napp.gone\n")
    assert main(["verify", *base, "--exported", str(tmp_path / "names")]) == 1
    report = json.loads((state / "verification.json").read_text())
    assert [(v["view"], v["row_count"], v["row_status"]) for v in report["views"]] == [(VIEW, 5, "exact")]
    assert {m["view"]: m["status"] for m in report["reconciliation"]} == {VIEW: "matched", "app.gone": "missing"}
    assert main(["verify", *base]) == 0
    for name, text in (("good", document()), ("wrong", document("wrong", predicate="nothing < 0"))):
        (tmp_path / f"{name}.json").write_text(json.dumps(text))
    assert main(["validate", *base, "--checks", str(tmp_path / "good.json")]) == 0
    assert main(["validate", *base, "--checks", str(tmp_path / "good.json"), str(tmp_path / "wrong.json")]) == 1
    assert "slow: valid" in capsys.readouterr().out
