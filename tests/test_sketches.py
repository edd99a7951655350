"""Heavy values, profiles under a deadline and relationships under a budget."""

from datetime import datetime

import pytest

from plumbline.operators import drafts, profile, sketches
from plumbline.sources.guard import Source
from plumbline.sources.state import Store

NOW = datetime(2024, 6, 30)


class Counting(Source):
    """Lets so many jobs through and has no time for the others."""

    left, ran = 10**6, 0

    def within(self, seconds, job):
        if self.left <= 0:
            return None
        self.left -= 1
        self.ran += 1
        return job()


@pytest.fixture(scope="module")
def rows(spark):
    return spark.range(20_000).selectExpr("CAST(id AS INT) AS row_id", "CASE WHEN id % 4 = 0 THEN 0 ELSE CAST(id AS INT) END AS visit_id", "CASE WHEN id % 10 = 0 THEN NULL WHEN id % 3 = 0 THEN '' WHEN id % 500 = 1 THEN 'rare' ELSE CONCAT('v', id) END AS word", "CAST(id % 7 AS DOUBLE) AS few")


def test_heavy_values_are_exact(spark, rows):
    columns = ["row_id", "visit_id", "word", "few"]
    got = {tuple(r) for r in sketches.heavy_values(rows, columns, 0.002).collect()}
    want = {(r["column_name"], r["value"], r["frequency"], 20_000) for r in profile.frequencies(rows, columns).where("frequency >= 40").collect()}
    assert got == want and ("word", None, 2_000, 20_000) in got and ("word", "rare", 24, 20_000) not in got
    named = {tuple(r)[:3] for r in sketches.heavy_values(rows, ["row_id"], also=[("row_id", "17")]).collect()}
    assert named == {("row_id", "17", 1)}
    plan = sketches.heavy_values(rows, ["row_id"])._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_top_values_equal_those_of_all_counts(spark, rows):
    columns = ["row_id", "visit_id", "word", "few"]
    want = sorted(map(tuple, profile.top_values(profile.frequencies(rows, columns)).collect()), key=str)
    assert sorted(map(tuple, sketches.top_values(rows, columns).collect()), key=str) == want
    assert [tuple(r) for r in sketches.key_sentinel(rows, ["visit_id", "row_id"]).collect()] == [("visit_id", "0", 5_000, 20_000)]


@pytest.fixture(scope="module")
def files(spark, rows, tmp_path_factory):
    path = f"file://{tmp_path_factory.mktemp('view')}/t"
    rows.repartition(6).write.parquet(path)
    return spark.read.parquet(path)


def test_a_profile_in_time_is_exact(spark, files, tmp_path):
    got, status = sketches.profile_within(Source(spark, {"a.t": files}), "a.t", 600, Store(spark, f"file://{tmp_path}"), "r")
    want = profile.profile(files)
    assert status == "exact" and sorted(map(tuple, got.select(*want.columns).collect())) == sorted(map(tuple, want.collect()))


def test_groups_that_were_done_stand(spark, files, tmp_path):
    """Six groups of a file each; there is time for four, then, on another call, for the rest but not for the exact count."""
    store, source = Store(spark, f"file://{tmp_path}"), Counting(spark, {"a.t": files})
    source.left = 4
    got, status = sketches.profile_within(source, "a.t", 600, store, "r", groups=6)
    first = {r["column_name"]: r for r in got.collect()}
    assert status == "approximate" and first["row_id"]["coverage"] == pytest.approx(4 / 6) and 0 < first["row_id"]["rows"] < 20_000
    source.left, source.ran = 2, 0
    got, status = sketches.profile_within(source, "a.t", 600, store, "r", groups=6)
    then = {r["column_name"]: r for r in got.collect()}
    true = {r["column_name"]: r for r in profile.profile(files).collect()}
    assert status == "approximate" and source.ran == 2
    for c, r in then.items():
        assert r["coverage"] == 1 and (r["rows"], r["null_count"], r["min_value"], r["max_value"], r["max_length"], r["avg_length"]) == tuple(true[c][x] for x in ("rows", "null_count", "min_value", "max_value", "max_length", "avg_length"))
        assert abs(r["distinct_count"] - true[c]["distinct_count"]) <= 0.05 * true[c]["distinct_count"] and r["column_class"] == true[c]["column_class"]
    source.left = 1
    assert sketches.profile_within(source, "a.t", 600, store, "r", groups=6)[1] == "exact"


def test_a_profile_without_any_time(spark, rows, tmp_path):
    source = Counting(spark, {"a.t": rows})
    source.left = 0
    got, status = sketches.profile_within(source, "a.t", 600, Store(spark, f"file://{tmp_path}"), "r")
    assert status == "timeout" and {r["column_name"]: r["column_class"] for r in got.collect()} == {"row_id": "key", "visit_id": "key", "word": "identifier_or_freetext", "few": "identifier_or_freetext"}
    found = drafts.catalog(spark, {"a.t": rows}, as_of=NOW, store=Store(spark, f"file://{tmp_path}/c"), timeout_s=-1)
    assert found["views"][0]["status"] == "timeout" and found["views"][0]["row_count"] is None and drafts.generate(found, as_of=NOW) == []


def test_other_errors_are_raised(spark, tmp_path):
    bad = spark.range(3).selectExpr("CAST(raise_error('broken') AS INT) AS x")
    with pytest.raises(Exception, match="broken"):
        sketches.profile_within(Source(spark, {"a.t": bad}), "a.t", 600, Store(spark, f"file://{tmp_path}"), "r")


@pytest.fixture(scope="module")
def related(spark):
    n = lambda k, e: spark.range(k).selectExpr(e)
    return {"a.x": n(5_000, "CAST(id AS INT) AS x_id"), "a.y": n(4_000, "CAST(id * 2 AS INT) AS y_id"), "a.z": n(6_000, "CAST(id + 4500 AS INT) AS z_id"), "a.w": n(3_000, "CONCAT('w', id) AS w_id")}


PAIRS = [("a.x", "x_id", "a.y", "y_id"), ("a.z", "z_id", "a.x", "x_id"), ("a.y", "y_id", "a.z", "z_id"), ("a.w", "w_id", "a.x", "x_id")]


def test_containments_by_sketch_then_exactly(spark, related, tmp_path):
    got = {tuple(r)[:4]: r for r in sketches.containments_within(Source(spark, related), PAIRS, None, Store(spark, f"file://{tmp_path}"), "r", lg_k=9).collect()}
    true = {tuple(r)[:4]: r for r in profile.containments(related, PAIRS).collect()}
    assert {p: r["status"] for p, r in got.items()}[PAIRS[0]] == "exact" and got[PAIRS[1]]["status"] == got[PAIRS[3]]["status"] == "estimated"
    for p, r in got.items():
        assert abs(r["common"] - true[p]["common"]) <= r["bound"]
        if r["status"] == "exact":
            assert all(r[c] == true[p][c] for c in true[p].asDict())


def test_a_resumed_call_evaluates_nothing_twice(spark, related, tmp_path):
    store, source = Store(spark, f"file://{tmp_path}"), Counting(spark, related)
    ask = lambda: {tuple(r)[:4]: r["status"] for r in sketches.containments_within(source, PAIRS, 600, store, "r", lg_k=9, contained=0.1, at_once=1).collect()}
    source.left = 0
    assert set(ask().values()) == {"skipped_cost"}
    source.left = 2  # the sketches and one exact pair
    assert sorted(ask().values()).count("exact") == 1 and source.ran == 2
    source.left, source.ran = 10, 0
    after = ask()
    open_ = sum(s == "exact" for s in after.values()) - 1
    assert source.ran == open_ > 0
    source.ran = 0
    assert ask() == after and source.ran == 0


def test_catalog_under_a_deadline(spark, related, tmp_path):
    found = drafts.catalog(spark, related, as_of=NOW, store=Store(spark, f"file://{tmp_path}"), timeout_s=600)
    plain = drafts.catalog(spark, related, as_of=NOW)
    keys = ("view_a", "column_a", "view_b", "column_b", "common", "orphans_a", "orphans_b")
    assert [[r[k] for k in keys] for r in found["relationships"]] == [[r[k] for k in keys] for r in plain["relationships"]]
    assert {v["status"] for v in found["views"]} == {"exact"}


def test_keys_of_large_views(spark, rows, monkeypatch):
    """Top values of a large view's keys come without a count of all keys, and sentinels are the same."""
    small = drafts.catalog(spark, {"a.t": rows}, as_of=NOW)["views"][0]
    monkeypatch.setattr(profile, "LARGE_VIEW", 10)
    large = drafts.catalog(spark, {"a.t": rows}, as_of=NOW)["views"][0]
    assert [{k: v for k, v in c.items()} for c in large["columns"]] == small["columns"]
    assert {(s["column_name"], s["sentinel_type"], s["value"], s["frequency"]) for s in small["sentinels"]} <= {(s["column_name"], s["sentinel_type"], s["value"], s["frequency"]) for s in large["sentinels"]} | {("row_id", "zero_or_negative_id", "0", 1)}
