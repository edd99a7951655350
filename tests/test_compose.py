"""The template cache, the client's repair round, and the review gate over state tables."""

import json
from datetime import datetime

import pytest

from plumbline import checks
from plumbline.__main__ import main
from plumbline.operators import compose, narrate, review
from plumbline.plans.document import CheckError
from plumbline.sources.guard import Source
from plumbline.sources.state import Store

NOW = datetime(2024, 6, 30)
CHECK = checks.load("appointment-completed-no-invoice")


class Says:
    """Answers one after the other; a callable is called."""

    def __init__(self, *answers):
        self.answers, self.prompts = list(answers), []

    def complete(self, prompt):
        self.prompts.append(prompt)
        answer = self.answers.pop(0)
        if isinstance(answer, Exception):
            raise answer
        return answer


def answer(template, *actions):
    return json.dumps({"template": template, "actions": list(actions)})


def found(spark, *rows):
    return spark.createDataFrame([(i, v, s, e, {"invoice_lag_days": "7"}) for i, (v, s, e) in enumerate(rows)], f"k int, {compose.FINDINGS}")


def shown(spark, rows, store, **more):
    told = compose.composed(rows, {"v1": CHECK}, store.read("templates", compose.TEMPLATES), "Finding {{ id }}", **more)
    return {r["k"]: (r["narrative_status"], r["text"], [v["rule"] for v in r["violations"]]) for r in told.collect()}


def test_a_second_run_asks_for_no_known_group(spark, tmp_path):
    store, client = Store(spark, f"file://{tmp_path}"), Says(answer("Appointment {{ id }} of {{ patient }}", *CHECK.actions[:1]), answer("Only {{id}}"))
    rows = found(spark, ("v1", "a", {"id": "17", "patient": "3"}), ("v1", "a", {"id": "18", "patient": "INV-4"}), ("v1", "b", {"id": "19"}))
    assert compose.templates(rows, {"v1": CHECK}, client, store) == 2 and compose.templates(rows, {"v1": CHECK}, client, store) == 0
    assert shown(spark, rows, store) == {0: ("valid", "Appointment 17 of 3", []), 1: ("valid", "Appointment 18 of INV-4", []), 2: ("valid", "Only 19", [])}
    assert all(v not in p for p in client.prompts for v in ("17", "18", "INV-4")) and "patient" in client.prompts[0]
    more = found(spark, ("v1", "c", {"id": "20"}))
    assert compose.templates(more, {"v1": CHECK}, Says(answer("{{id}}")), store, mode="off") == 1 and store.read("templates", compose.TEMPLATES).count() == 3


def test_one_repair_then_the_fallback_is_remembered(spark, tmp_path):
    store, rows = Store(spark, f"file://{tmp_path}"), found(spark, ("v1", "a", {"id": "17"}), ("v1", "b", {"id": "18", "patient": "3"}), ("v1", "c", {"id": "19"}))
    client = Says("nonsense", "```json\n" + answer("Fine {{ id }}") + "\n```", answer("It cost 42"), answer("Lost {{gone}}"), TimeoutError("late"), TimeoutError("late"))
    assert compose.templates(rows, {"v1": CHECK}, client, store) == 3 and not client.answers
    kept = {r["shape"]: r for r in store.read("templates", compose.TEMPLATES).collect()}
    assert [(kept[s]["status"], kept[s]["asked"]) for s in "abc"] == [("valid", 2), ("blocked_fallback", 2), ("fallback_static", 2)]
    assert "unresolvable_placeholder" in kept["b"]["error"] and "It was refused" in client.prompts[1] and "42" in client.prompts[3]
    assert shown(spark, rows, store) == {0: ("valid", "Fine 17", []), 1: ("blocked_fallback", "Finding 18", []), 2: ("fallback_static", "Finding 19", [])}
    assert compose.templates(rows, {"v1": CHECK}, Says(), store) == 0


def test_a_kept_template_is_judged_on_each_finding(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}")
    rows = found(spark, ("v1", "a", {"id": "17", "patient": "3"}), ("v1", "a", {"id": "18"}), ("v1", "a", {}))
    compose.templates(rows.where("k = 0"), {"v1": CHECK}, Says(answer("Of {{ patient }}")), store)
    assert shown(spark, rows, store) == {0: ("valid", "Of 3", []), 1: ("blocked_fallback", "Finding 18", ["unresolvable_placeholder"]), 2: ("blocked_fallback", "Finding None", ["unresolvable_placeholder"])}


def test_without_a_client_nothing_is_remembered(spark, tmp_path):
    store, rows = Store(spark, f"file://{tmp_path}"), found(spark, ("v1", "a", {"id": "17"}), ("v9", "a", {"id": "1"}))
    assert compose.templates(rows, {"v1": CHECK}, None, store) == 0 and store.version("templates") == 0
    assert shown(spark, rows, store) == {0: ("fallback_static", "Finding 17", []), 1: ("fallback_static", "Finding 1", [])}
    with pytest.raises(ValueError):
        compose.templates(rows, {"v1": CHECK}, None, store, mode="some")
    told = narrate.with_rendering(rows.where("k = 0").selectExpr("*", "'{{ invoice_lag_days }} days, {{id}}' AS t"), "t", "x").first()["x"]
    assert told == "7 days, 17"


def test_drafts_of_a_client_are_repaired_once(spark, tmp_path):
    doc = lambda name, predicate="status = 'x'": {"id": name, "title": "t", "category": "workflow", "default_severity": "low", "entity": {"view": "clinic.appointments", "key": ["id"], "practice_column": "practice", "base_filters": []}, "params": {}, "prerequisites": [], "predicate": predicate, "evidence": ["id"], "actions": ["book-recall"], "resolution": "r"}
    columns = {"clinic.appointments": ["id", "practice", "status"]}
    spark.createDataFrame([(1, 1, "x")], "id int, practice int, status string").createOrReplaceTempView("clinic__appointments")
    client = Says(json.dumps([doc("good"), doc("mended", "gone = 1"), doc("lost", "gone = 1"), doc("worse", "gone = 1")]), json.dumps([doc("mended")]), json.dumps([doc("lost", "gone = 2")]), "no json")
    good, bad = compose.drafted(client, spark, "brief", columns)
    assert [c.id for c in good] == ["good", "mended"] and len(bad) == 2 and "gone" in bad[0][1] and "no repair" in bad[1][1] and "gone" in client.prompts[1]


def appointments(spark):
    return spark.createDataFrame([(1, 1, "strange"), (2, 1, "3-MEDIUM"), (3, 1, None)], "id int, practice int, status string")


DOC = {"id": "odd-status", "title": "t", "category": "workflow", "default_severity": "low", "entity": {"view": "app.visits", "key": ["id"], "practice_column": "practice", "base_filters": []}, "params": {}, "prerequisites": ["status IS NOT NULL"], "predicate": "status = 'strange'", "evidence": ["id"], "actions": ["book-recall"], "resolution": "r"}


def test_reviews_survive_a_restart(spark, tmp_path):
    def gate():
        return review.Reviews(Source(spark, {"app.visits": appointments(spark)}), Store(spark, f"file://{tmp_path}"), NOW)

    never = DOC | {"predicate": "status = 'never'"}
    say = lambda batch, *commands: [(e["command"], e["outcome"], e["status"], e["version"]) for e in gate().submit(batch, [{"slug": "odd-status", "actor": "me"} | c for c in commands])]
    assert say("b1", {"command": "add", "document": never}) == [("add", "done", "draft", 1)]
    assert say("b2", {"command": "approve"}, {"command": "reject"}, {"command": "shout"}) == [("approve", "dry_run_failed", "draft", 1), ("reject", "note_missing", "draft", 1), ("shout", "unknown_command", "draft", 1)]
    assert say("b3", {"command": "reject", "note": "never fails"}) == [("reject", "done", "rejected", 1)]
    mend = [{"command": "amend", "document": DOC, "note": "now it does"}, {"command": "approve"}, {"command": "approve"}]
    assert say("b4", *mend) == [("amend", "done", "draft", 2), ("approve", "done", "active", 2), ("approve", "not_a_draft", "active", 2)]
    assert say("b4", *mend) == say("b4", *mend)  # a batch that is sent again changes nothing
    assert [c.id for c in gate().active()] == ["odd-status"] and gate().history().count() == 8
    assert say("b5", {"command": "add", "document": never})[0][1] == "known_already" and json.loads(gate().now().first()["document"]) == DOC
    with pytest.raises(CheckError):
        gate().submit("b6", [{"slug": "odd-status", "command": "amend", "document": DOC | {"id": "other"}, "note": "x"}])


def test_review_command(spark, tmp_path, capsys, monkeypatch):
    appointments(spark).write.parquet(f"{tmp_path}/visits")
    (tmp_path / "c.yaml").write_text(json.dumps(DOC))
    own = ["review", "--views", f"app.visits=file://{tmp_path}/visits", "--state", str(tmp_path / "state"), "--as-of", "2024-06-30"]
    assert main([*own, "--do", "add", "--checks", str(tmp_path / "c.yaml"), "--reviewer", "me"]) == 0 and main([*own, "--do", "approve", "--slug", "odd-status"]) == 0
    assert main([*own, "--do", "reject", "--slug", "odd-status", "--note", "late"]) == 1 and main([*own, "--status", "active"]) == 0
    assert main([*own, "--do", "show", "--slug", "odd-status"]) == 0 and main([*own, "--do", "show", "--slug", "nobody"]) == 1
    out = capsys.readouterr().out
    assert "odd-status\tactive\tv1" in out and "'fail': 1" in out and "not_a_draft" in out
    assert main(["run", *own[1:], "--run-id", "r1"]) == 0 and "| odd-status | 1 | 3 | 1 | 1 | 1 |" in capsys.readouterr().out
