"""Runs that fail, overlap and break off lose no finding and tell no event twice."""

import threading
from datetime import datetime, timedelta

import pytest

from plumbline.operators import execute, findings
from plumbline.operators.run import EXECUTIONS, WATERMARKS, Plan, executions, history, run
from plumbline.plans.document import from_dict
from plumbline.sources.guard import Source
from plumbline.sources.state import GRACE, Store
from plumbline.streaming.checks import start

VIEW, NOW = "app.rows", datetime(2024, 6, 30)


def check(name="negative", predicate="value < 0"):
    return from_dict({"id": name, "title": "t", "category": "workflow", "default_severity": "low", "entity": {"view": VIEW, "key": ["id"], "practice_column": "practice", "base_filters": []}, "params": {}, "prerequisites": [], "predicate": predicate, "evidence": ["id", "value"], "actions": ["correct-record"], "resolution": "r"})


def rows(spark, *values):
    """Rows (id, value, day)."""
    return spark.createDataFrame([(i, 1, float(v), datetime(2024, 1, d)) for i, v, d in values], "id int, practice int, value double, at timestamp_ntz")


class Late(Source):
    def within(self, seconds, job):
        return None


def found(store):
    return {r["entity_key"]: (r["status"], r["first_seen_run"], r["last_seen_run"]) for r in store.read("findings", findings.FINDINGS).where("check_id NOT LIKE 'system%'").collect()}


@pytest.mark.parametrize("plan", [Plan(column="at"), Plan(key=("id",))])
def test_a_scan_that_took_too_long_is_made_up_for(spark, tmp_path, plan):
    store, view = Store(spark, f"file://{tmp_path}"), {VIEW: rows(spark, (1, -1, 1), (2, 1, 2))}
    options = {"plans": {VIEW: plan}, "lookback": timedelta(0)}
    assert run(Late(spark, view), store, [check()], run_id="r1", as_of=datetime(2024, 1, 5), timeout_s=1, **options).status == "completed_with_errors"
    assert store.read("watermarks", WATERMARKS).count() == 0 and store.version("key_sets") == 0
    r = run(Source(spark, view), store, [check()], run_id="r2", as_of=datetime(2024, 1, 6), **options)
    assert r.stats == {"created": 1} and found(store) == {'{"id":1}': ("open", "r2", "r2")}
    again = run(Source(spark, view), store, [check()], run_id="r3", as_of=datetime(2024, 1, 7), **options)
    assert again.executions == []  # now the mark and the key set have moved


def test_one_broken_check_of_two(spark, tmp_path):
    """The other one's findings are there, but the mark stays, as rows weren't judged by both."""
    store, two = Store(spark, f"file://{tmp_path}"), [check(), check("breaks", "CAST(raise_error('no') AS INT) = 1")]
    source, options = Source(spark, {VIEW: rows(spark, (1, -1, 1), (2, 1, 2))}), {"watermarks": {VIEW: "at"}, "lookback": timedelta(0)}
    r = run(source, store, two, run_id="r1", as_of=NOW, **options)
    assert list(r.errors) == ["breaks"] and r.stats == {"created": 1} and found(store) == {'{"id":1}': ("open", "r1", "r1")}
    assert store.read("watermarks", WATERMARKS).count() == 0
    assert {(e["check_id"], e["status"]) for e in executions(store).collect()} == {("negative", "ok"), ("breaks", "error")}
    run(source, store, two[:1], run_id="r2", as_of=NOW, **options)
    assert store.read("watermarks", WATERMARKS).first()["value"] == NOW


class Breaking(Store):
    stops_at = None

    def write(self, name, *rest, **more):
        if name == self.stops_at:
            raise RuntimeError("the machine is gone")
        return super().write(name, *rest, **more)

    def append(self, name, *rest):
        if name == self.stops_at:
            raise RuntimeError("the machine is gone")
        return super().append(name, *rest)


@pytest.mark.parametrize("part", ["judged", "moves", "executions", "changes", "findings", "events", "watermarks", "ended"])
def test_a_run_that_broke_off_with_another_in_between(spark, tmp_path, part):
    root = f"file://{tmp_path}"
    broken, store = Breaking(spark, root), Store(spark, root)
    broken.stops_at = part
    one, two = Source(spark, {VIEW: rows(spark, (1, -1, 1), (2, -1, 2), (3, 1, 3))}), rows(spark, (1, -1, 1), (2, 1, 2), (3, -1, 3))
    options = {"watermarks": {VIEW: "at"}}
    if part == "judged":  # a view that can't be judged is an error of its checks
        assert "gone" in run(one, broken, [check()], run_id="a", as_of=NOW, **options).errors["negative"]
    else:
        with pytest.raises(RuntimeError):
            run(one, broken, [check()], run_id="a", as_of=NOW, **options)
    run(Source(spark, {VIEW: two}), store, [check()], run_id="b", as_of=NOW)
    run(one, store, [check()], run_id="a", as_of=NOW, **options)
    told = {}
    for e in history(store).where("check_id = 'negative'").collect():
        told.setdefault(e["dedupe_key"], []).append((e["run_id"], e["event"]))
    got = found(store)
    assert all(len(set(t)) == len(t) for t in told.values())
    if part == "judged":
        assert got == {'{"id":1}': ("open", "b", "b"), '{"id":3}': ("open", "b", "b")}
    elif part in ("events", "watermarks", "ended"):  # a landed before b
        assert got == {'{"id":1}': ("open", "a", "b"), '{"id":2}': ("resolved_system", "a", "b"), '{"id":3}': ("open", "b", "b")}
    else:
        assert got == {'{"id":1}': ("open", "b", "a"), '{"id":2}': ("open", "a", "a"), '{"id":3}': ("resolved_system", "b", "a")}
    if part != "judged":
        assert sorted(map(len, told.values())) == sorted([2, 1, 2] if part not in ("events", "watermarks", "ended") else [2, 2, 1])
        assert store.read("watermarks", WATERMARKS).first()["value"] == NOW and store.parts("judged", "") == []


def test_two_runs_at_once(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}")
    sources = {"a": rows(spark, (1, -1, 1), (2, -1, 2)), "b": rows(spark, (2, -1, 2), (3, -1, 3))}
    failed = []

    def go(name):
        try:
            run(Source(spark, {VIEW: sources[name]}), Store(spark, f"file://{tmp_path}"), [check(f"c{name}")], run_id=name, as_of=NOW)
        except Exception as e:  # noqa: BLE001
            failed.append(e)

    # each has a view of its own name, as temporary views are the session's
    threads = [threading.Thread(target=go, args=(n,)) for n in sources]
    for t in threads:
        t.start()
        t.join(0.0 if t is threads[0] else None)
    threads[0].join()
    assert not failed
    by = {(r["check_id"], r["last_seen_run"]) for r in store.read("findings", findings.FINDINGS).where("check_id LIKE 'c%'").collect()}
    assert {x[1] for x in by} == {"a", "b"} and store.version("findings") == 2
    assert {r["run_id"] for r in history(store).collect()} == {"a", "b"}


def test_a_view_is_scanned_once(spark, tmp_path):
    rows(spark, *((i, i % 3 - 1, 1 + i % 20) for i in range(100))).write.parquet(f"{tmp_path}/rows")
    view, store = spark.read.parquet(f"file://{tmp_path}/rows"), Store(spark, f"file://{tmp_path}/state")
    before = _scans(spark, f"{tmp_path}/rows")
    r = run(Source(spark, {VIEW: view}), store, [check(), check("zero", "value = 0"), check("open", "value < CAST(NULL AS DOUBLE)")], run_id="r1", as_of=NOW)
    assert _scans(spark, f"{tmp_path}/rows") - before == 1
    want = execute.tally(execute.run_rows(Source(spark, {VIEW: view}), [check(), check("zero", "value = 0"), check("open", "value < CAST(NULL AS DOUBLE)")], as_of=NOW))
    names = ["check_id", "practice_id", "n_examined", "n_fail", "n_pass", "n_indeterminate", "indeterminate_rate"]
    assert sorted(map(tuple, store.part("executions", EXECUTIONS, "r1").select(*names).collect())) == sorted(map(tuple, want.select(*names).collect()))
    assert r.stats["created"] == 34 + 33 + 1


def _scans(spark, path):
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    found = spark._jsparkSession.sharedState().statusStore().executionsList()
    return sum(found.apply(i).physicalPlanDescription().count(f"file:{path}]") > 0 for i in range(found.size()))


def test_reports_say_what_they_leave_out(spark, tmp_path):
    from plumbline.operators import run as module

    many = spark.range(7).selectExpr("CAST(id AS INT) id", "CAST(id AS INT) practice", "-1D value", "CAST(NULL AS TIMESTAMP_NTZ) at")
    shown = module.SHOWN
    module.SHOWN = 5
    try:
        r = run(Source(spark, {VIEW: many}), Store(spark, f"file://{tmp_path}"), [check()], run_id="r1", as_of=NOW)
    finally:
        module.SHOWN = shown
    assert len(r.executions) == 5 and r.more == 2 and "| and 2 more |" in r.markdown()


def test_versions_are_compared_and_swapped(spark, tmp_path):
    store, one = Store(spark, f"file://{tmp_path}"), spark.range(1)
    assert store.write("t", one, base=0, by="a") == 1 and store.write("t", one, base=0, by="b") is None
    assert store.write("t", one, base=1, by="b") == 2 and [(v.number, v.by) for v in store.versions("t")] == [(1, "a"), (2, "b")]
    assert store._claim(f"{store.root}/t/_claims/3")  # its writer breaks off
    assert store.version("t") == 2 and store.write("t", one, base=2) == 4 and GRACE < 60
    for n in range(5, 9):
        assert store.write("t", spark.range(n)) == n
    assert store.read("t", "id long").count() == 8 and store.read("t", "id long", 7).count() == 7
    assert len([p for p in tmp_path.joinpath("t").iterdir() if p.name.startswith("d=")]) == 2


def test_a_batch_keeps_the_time_of_its_first_try(spark, tmp_path):
    """Two batches at two times; a lookback moves with them, and the one that is tried again is judged at its first time."""
    old = check("old", "at < DATEADD(DAY, -30, getdate())")
    for n, day in enumerate((1, 2)):
        rows(spark, (n, 1, day)).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(rows(spark).schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    store, clock = Store(spark, f"file://{tmp_path}/state"), iter([datetime(2024, 1, 20), datetime(2024, 3, 1), datetime(2025, 1, 1)])
    start(stream, VIEW, {}, [old], store, as_of=lambda: next(clock), checkpoint=f"{tmp_path}/cp").awaitTermination()
    assert [r["n_fail"] for r in executions(store).where("check_id = 'old'").orderBy("run_id").collect()] == [0, 1]
    broken = Breaking(spark, f"file://{tmp_path}/again")
    broken.stops_at = "findings"
    with pytest.raises(RuntimeError):
        run(Source(spark, {VIEW: rows(spark, (1, 1, 1))}), broken, [old], run_id="s-0", as_of=datetime(2024, 1, 20))
    r = run(Source(spark, {VIEW: rows(spark, (1, 1, 1))}), Store(spark, f"file://{tmp_path}/again"), [old], run_id="s-0", as_of=datetime(2025, 1, 1))
    assert r.executions[0]["n_fail"] == 0


def keyed(spark, *values):
    return spark.createDataFrame([(i, 1, float(v), datetime(2024, 1, 1)) for i, v in values], "id int, practice int, value double, at timestamp_ntz")


def test_only_changed_ranges_are_judged(spark, tmp_path):
    """Keys come and go in a few ranges; other rows aren't read, and findings of entities that are gone are resolved."""
    store, plan = Store(spark, f"file://{tmp_path}"), {VIEW: Plan(key=("id",), ranges=True)}
    first = [(i, -1 if i % 100 == 0 else 1) for i in range(10_000)]
    r = run(Source(spark, {VIEW: keyed(spark, *first)}), store, [check()], run_id="r1", as_of=NOW, plans=plan)
    assert r.strategies == {VIEW: "full_scan"} and r.stats["created"] == 100
    assert run(Source(spark, {VIEW: keyed(spark, *first)}), store, [check()], run_id="r2", as_of=NOW, plans=plan).strategies == {VIEW: "unchanged"}
    then = [x for x in first if x[0] != 500] + [(12_345, -1)]  # one entity with a finding is gone, one has come
    r = run(Source(spark, {VIEW: keyed(spark, *then)}), store, [check()], run_id="r3", as_of=NOW, plans=plan)
    ok = {e["check_id"]: e for e in r.executions}
    assert r.strategies == {VIEW: "ranges"} and ok["negative"]["n_examined"] < 20 and r.stats == {"created": 1, "resolved_system": 1}
    assert found(store)['{"id":500}'][0] == "resolved_system" and found(store)['{"id":12345}'] == ("open", "r3", "r3")
    r = run(Source(spark, {VIEW: keyed(spark, *then)}), store, [check(), check("old", "at < DATEADD(DAY, -30, getdate())")], run_id="r4", as_of=NOW, plans=plan)
    assert r.strategies == {VIEW: "full_scan"}  # time alone can change an outcome


def test_ranges_stay_until_they_were_judged(spark, tmp_path):
    store, plan = Store(spark, f"file://{tmp_path}"), {VIEW: Plan(key=("id",), ranges=True)}
    run(Source(spark, {VIEW: keyed(spark, (1, 1), (2, 1))}), store, [check()], run_id="r1", as_of=NOW, plans=plan)
    more = {VIEW: keyed(spark, (1, 1), (2, 1), (3, -1))}
    run(Late(spark, more), store, [check()], run_id="r2", as_of=NOW, plans=plan, timeout_s=1)
    r = run(Source(spark, more), store, [check()], run_id="r3", as_of=NOW, plans=plan)
    assert r.strategies == {VIEW: "ranges"} and r.stats["created"] == 1


def test_ranges_of_keys(spark):
    from plumbline.operators import keysets

    old, new = keyed(spark, (1, 1), (2, 1), (7, 1), (7, 2), (40, 1)), keyed(spark, (2, 1), (1, 1), (7, 1), (8, 1))
    where = keysets.layout(old, ("id",), 10)
    assert (where.low, where.width) == (1, 4)
    got = keysets.changed(keysets.summary(old, where), keysets.summary(new, where))
    assert sorted(map(tuple, got.collect())) == [(1, 1, 2), (9, 1, 0)]
    assert [r["id"] for r in new.where(where.condition([1, 2])).orderBy("id").collect()] == [7, 8]
    many = where.condition([3 * i for i in range(1000)])
    assert many.count("OR") == keysets.CONDITIONS - 1 and old.where(many).count() <= 5
    pairs = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c"), (None, "c")], "x int, y string")
    both = keysets.layout(pairs, ("x", "y"), 16)
    assert both.width is None and keysets.changed(keysets.summary(pairs, both), keysets.summary(pairs.dropDuplicates(), both)).count() == 0
    assert keysets.layout(old.limit(0), ("id",)).width is None
    gone = spark.createDataFrame([('{"x":1,"y":"a"}',), ('{"x":9,"y":"z"}',)], "entity_key string")
    assert [r["entity_key"] for r in keysets.vanished(gone, pairs, both, list(range(16))).collect()] == ['{"x":9,"y":"z"}']
    plan = new.where(where.condition([1]))._jdf.queryExecution().optimizedPlan().toString()
    assert ">= 5" in plan and "< 9" in plan
