from datetime import datetime

import pytest

from plumbline.operators import drafts, narrate, profile, reconcile
from plumbline.operators.review import Gate
from plumbline.plans.document import CheckError, from_dict
from plumbline.sources import catalog as catalogs
from plumbline.sources import documents
from plumbline.sources.guard import Source

NOW = datetime(2024, 6, 30)


@pytest.fixture(scope="module")
def visits(spark):
    rows = [(i, i % 3, None if i % 5 == 0 else "" if i % 7 == 0 else "ok", "n" * 10, datetime(2024, 1, 1 + i % 20) if i else datetime(1900, 1, 1), i % 4) for i in range(300)]
    return spark.createDataFrame(rows, "VisitKey int, Status int, Label string, FirstName string, SeenAt timestamp_ntz, practice int")


def test_profile(visits):
    p = {r["column_name"]: r for r in profile.profile(visits).collect()}
    assert p["VisitKey"]["column_class"] == "key" and p["VisitKey"]["distinct_count"] == 300
    assert p["FirstName"]["column_class"] == "identifier_or_freetext" and p["FirstName"]["min_value"] is None
    assert p["Label"]["null_count"] == 60 and p["Label"]["null_rate"] == 0.2 and p["Label"]["column_class"] == "categorical_coded"
    assert p["SeenAt"]["min_value"] == "1900-01-01 00:00:00"


def test_empty_view(spark):
    p = profile.profile(spark.createDataFrame([], "ID int, name string")).collect()
    assert [(r["rows"], r["null_rate"], r["distinct_count"]) for r in p] == [(0, None, None)] * 2


def test_sentinels_and_tops(visits):
    stats = profile.profile(visits)
    tops = profile.top_values(profile.frequencies(visits, ["VisitKey", "Status", "Label"]))
    got = {(r["column_name"], r["sentinel_type"]) for r in profile.sentinels(stats, tops).collect()}
    assert {("SeenAt", "placeholder_date"), ("VisitKey", "zero_or_negative_id"), ("Label", "empty_string_overload")} <= got
    assert tops.where("column_name = 'Label' AND rank = 1").first()["value"] == "ok"


def test_sampling_tiers(visits, spark):
    assert profile.sampling(visits, 100)[0] is None
    assert visits.where(profile.sampling(visits, 200_000)[0]).count() == 30
    other = visits.drop("VisitKey")
    assert profile.sampling(other, 200_000, "SeenAt", (datetime(2024, 1, 1), datetime(2024, 1, 21)))[1].startswith("SeenAt >=")
    assert profile.sampling(other, 200_000)[1] == "hash % 10 = 0"


def test_containment(spark):
    a, b = (spark.createDataFrame([(x,) for x in xs], "v int") for xs in ([1, 2, 2, 3, None], [2, 3, 4, 5]))
    one = profile.containment(a, "v", b, "v").first().asDict()
    many = profile.containments({"x.a": a, "x.b": b}, [("x.a", "v", "x.b", "v")]).first().asDict()
    assert one == {k: many[k] for k in one} and one["orphans_a"] == 1 and one["containment_b"] == 0.5


def test_watermark_reasons(spark):
    df = spark.createDataFrame([(1, NOW, NOW, datetime(2030, 1, 1)), (2, None, NOW, NOW)], "InsertedAt int, a timestamp_ntz, b timestamp_ntz, c timestamp_ntz")
    got = {r["column_name"]: r["reason"] for r in profile.watermark_fitness(df, ["InsertedAt", "a", "b", "c"], NOW, {"b": datetime(2025, 1, 1)}).collect()}
    assert got == {"InsertedAt": "wrong_type", "a": "null_values_present", "b": "non_monotonic_vs_baseline", "c": "future_dated_max"}


def test_reference_views(spark):
    df = spark.createDataFrame([(i, f"name {i} (tag{i % 2})") for i in range(40)], "DiseaseID int, DiseaseName string")
    f = profile.families(df)
    assert profile.archetype(profile.profile(df), list(f), f).first()["archetype"] == "reference"
    assert [r["tag"] for r in profile.trailing_tags(df, "DiseaseName").collect()] == [" (tag0)", " (tag1)"]
    assert profile.reference_sample(df, "DiseaseName", "DiseaseID", 3).count() == 3


def test_catalog_to_drafts_to_review(spark, visits, tmp_path):
    views = {"app.visits": visits, "app.calls": spark.createDataFrame([(i, i + 1, i % 4) for i in range(300)], "CallKey int, VisitKey int, practice int")}
    found = drafts.catalog(spark, views, as_of=NOW)
    assert catalogs.write(str(tmp_path), found)[0] == 1 and catalogs.write(str(tmp_path), found)[0] == 2
    assert catalogs.columns(catalogs.read(str(tmp_path)))["app.calls"] == ["CallKey", "VisitKey", "practice"] and "app.visits" in catalogs.report(found)
    docs = drafts.generate(found, as_of=NOW)
    names = [d["id"] for d in docs]
    assert "calls-visit-key-orphan-visits" in names and "visits-visit-key-duplicate" in names and names == [d["id"] for d in drafts.generate(found, as_of=NOW)]
    gate = Gate(Source(spark, views), NOW)
    assert gate.add(docs[names.index("calls-visit-key-orphan-visits")]) and not gate.add(docs[names.index("calls-visit-key-orphan-visits")])
    assert gate.dry_run("calls-visit-key-orphan-visits") == {"fail": 1, "pass": 299, "indeterminate": 0}
    with pytest.raises(CheckError, match="dry run"):
        gate.approve("calls-visit-key-orphan-visits")
    doc = {**docs[names.index("calls-visit-key-orphan-visits")], "prerequisites": []}
    gate.amend("calls-visit-key-orphan-visits", doc, "no prerequisite")
    gate.approve("calls-visit-key-orphan-visits", "fine")
    assert gate.list("active")[0].notes == ("no prerequisite", "fine")
    good, bad = drafts.accepted(spark, [doc, {"id": "x"}], Source(spark, views).columns())
    assert [c.id for c in good] == ["calls-visit-key-orphan-visits"] and "missing" in bad[0][1]
    assert all("FirstName" != c["name"] or not c["values"] for v in drafts.redacted(found) for c in v["columns"])


def test_profiling_resumes(spark, visits, tmp_path):
    one = drafts.catalog(spark, {"app.visits": visits}, as_of=NOW, resume=str(tmp_path), watermarks={"app.visits": ["SeenAt"]})
    again = drafts.catalog(spark, {"app.visits": visits.limit(0)}, as_of=NOW, resume=str(tmp_path))
    assert one["views"][0]["row_count"] == again["views"][0]["row_count"] == 300
    assert one["views"][0]["watermarks"][0]["fit"] and one["views"][0]["cost_ms"] > 0


def test_documents_in_and_out(spark, visits, tmp_path):
    (tmp_path / "h.json").write_text('{"views": [{"view": "V", "columns": [{"name": "A", "type": "int"}]}], "relations": [{"view_a": "V", "view_b": "W"}]}')
    columns, relations = documents.hypotheses(spark, f"file://{tmp_path}/h.json")
    live = spark.createDataFrame([("v", "PatientID", "int"), ("w", "patientid", "int")], "view string, column_name string, data_type string")
    assert columns.first()["data_type"] == "int" and reconcile.relations(relations, live).first()["shared"] == ["patientid"]
    (tmp_path / "n.txt").write_text("a.b # first\n\nc.d\n")
    assert [r["view"] for r in documents.export_names(spark, f"file://{tmp_path}/n.txt").collect()] == ["a.b", "c.d"]
    prose = spark.createDataFrame([("V", "Columns:\n| Name | varchar(10) |\nx | int\nno row")], "view string, t string")
    assert [tuple(r)[1:] for r in documents.documented_columns(prose, "view", "t").collect()] == [("Name", "varchar(10)"), ("x", "int")]
    assert documents.actions(spark).count() == 9
    found = documents.environment(Source(spark, {"app.visits": visits}), {"app.visits": ["SeenAt"]}, NOW)
    documents.write_environment(str(tmp_path / "env.json"), found)
    assert documents.baselines(str(tmp_path / "env.json"))["app.visits"]["SeenAt"].year == 2024 and "app.visits | 300" in (tmp_path / "env.md").read_text()
    documents.record_prompt(str(tmp_path / "p"), "ask", "answer", "names_only")
    assert "names_only" in (tmp_path / "p").read_text()


def test_slugs():
    assert [drafts.slug(x) for x in ("dbo.DiseaseID", "ScheduleDate", "o_orderkey")] == ["disease-id", "schedule-date", "o-orderkey"]


def test_narration():
    text, spans = narrate.render("{{ who }} owes {{amount}} since {{day}}", {"who": "x", "day": NOW.date(), "secret": 1}, {"amount": 1e-7})
    assert text == "x owes 0.0000001 since 2024-06-30" and spans[1].source == "params"
    ask = lambda template, said=None, **k: [r for r, _ in narrate.validate(template, said or narrate.render(template, {"who": "x", "secret": 1}, {})[0], evidence={"who": "x", "secret": 1}, params={}, declared={"who"}, actions={"book-recall"}, **k)]
    assert ask("{{who}} is late") == []
    assert ask("{{who}} owes 42") == ["unallowlisted_token"] and ask("{{who}} since 3 March") == ["unallowlisted_token"]
    assert ask("{{secret}}") == ["undeclared_evidence_field"] and ask("{{who}}", "y") == ["rendered_text_mismatch"] and ask("{{lost}}", "z") == ["unresolvable_placeholder"]
    assert ask("{{who}}", selected=["verify-invoice"]) == ["action_not_allowlisted"] and ask("{{who}} in 7 days", vocabulary={"7"}) == []
    assert [(k, t) for *_, k, t in narrate.tokens("On March 3rd, INV-42 cost 1,234.56 (1/2/2024)")] == [("date_like", "March 3rd"), ("code_like", "INV-42"), ("numeric", "1,234.56"), ("date_like", "1/2/2024")]
    with pytest.raises(ValueError):
        narrate.redaction_mode("some")


def test_tokens_in_sql_agree(spark):
    texts = ["On March 3rd, INV-42 cost 1,234.56 (1/2/2024)", "nothing", "2024-01-02T03:04 and E11.9"]
    got = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    rows = {(r["k"], r["kind"], r["token"]) for r in narrate.suspect_tokens(got, "k", "t").collect()}
    assert rows == {(k, kind, token) for k, t in enumerate(texts) for *_, kind, token in narrate.tokens(t)}


def test_reconciliation(spark):
    documented = spark.createDataFrame([("V", "A", "nvarchar"), ("V", "b", "int"), ("V", "c", "int")], "view string, column_name string, data_type string")
    live = spark.createDataFrame([("v", "a", "string"), ("v", "b", "string"), ("v", "d", "int"), ("w", "x", "int")], "view string, column_name string, data_type string")
    assert {(r["column_name"], r["discrepancy"]) for r in reconcile.columns(documented, live).collect()} == {("b", "type_mismatch"), ("c", "documented_missing_live"), ("d", "undocumented_live_column")}


def test_documents_need_a_dict():
    with pytest.raises(CheckError):
        from_dict([1])
