import copy

import pytest

from plumbline import checks
from plumbline.plans import leaf
from plumbline.plans.compiler import compile_check, compile_fused
from plumbline.plans.document import ACTIONS, CheckError, can_be_indeterminate, default_params, from_dict, validate

COLUMNS = {
    "clinic.appointments": ["id", "patient", "schedule_date", "completed", "status", "is_deleted", "practice"],
    "clinic.invoices": ["appointment", "line", "part", "supplier", "invoice_date", "active", "total"],
    "clinic.patients": ["id", "active", "nhi", "high_care", "balance", "practice"],
}


def doc(**changes):
    base = copy.deepcopy(checks.load("appointment-completed-no-invoice").raw)
    base.update(changes)
    return base


@pytest.mark.parametrize("name", checks.NAMES)
def test_own_documents_are_valid(spark, name):
    validate(spark, checks.load(name), COLUMNS)


@pytest.mark.parametrize(
    "changes, says",
    [
        ({"id": "Not Kebab"}, "Not Kebab"),
        ({"category": "gossip"}, "gossip"),
        ({"default_severity": "dire"}, "dire"),
        ({"predicate": {"some": []}}, "some"),
        ({"predicate": {"all": []}}, "all"),
        ({"predicate": {"exists": {"view": "x", "on": "1 = 1"}}}, "schema-qualified"),
        ({"predicate": {"exists": {"view": "a.b"}}}, "on"),
        ({"params": {"p": {"type": "integer"}}}, "default"),
        ({"params": {"p": {"type": "date", "default": {"strategy": "fixed", "value": 1}}}}, "date"),
        ({"evidence": []}, "evidence"),
        ({"actions": []}, "actions"),
        ({"extra": 1}, "extra"),
    ],
)
def test_malformed_documents_name_the_fault(changes, says):
    with pytest.raises(CheckError, match=says):
        from_dict(doc(**changes))


@pytest.mark.parametrize(
    "changes, says",
    [
        ({"predicate": "nowhere = 1"}, "nowhere"),
        ({"predicate": "completed = {unknown}"}, "unknown"),
        ({"predicate": {"not_exists": {"view": "clinic.nothing", "on": "1 = 1"}}}, "clinic.nothing"),
        ({"predicate": {"exists": {"view": "clinic.appointments", "on": "clinic.appointments.id = clinic.appointments.id"}}}, "own view"),
        ({"evidence": ["lost"]}, "lost"),
        ({"actions": ["shout"]}, "shout"),
        ({"prerequisites": ["clinic.invoices.total > 0"]}, "scope"),
    ],
)
def test_unknown_references_are_named(spark, changes, says):
    with pytest.raises(CheckError, match=says):
        validate(spark, from_dict(doc(**changes)), COLUMNS)


def test_leaf_rewrites():
    assert leaf.spark_sql("[a b] <= DATEADD(day, -{n}, getdate())") == "`a b` <= DATEADD(day, -:n, CAST(:as_of AS TIMESTAMP_NTZ))"
    assert leaf.spark_sql("DATEDIFF(DAY, f(a, b), c) > 3 AND LEN(x) = 2") == "date_diff(to_date(c), to_date(f(a, b))) > 3 AND length(rtrim(x)) = 2"
    assert leaf.spark_sql("x = '{no} [y] getdate()'") == "x = '{no} [y] getdate()'"
    assert leaf.spark_sql("v.t.c IN ({xs})", ("v.t",), {"xs": 2}) == "`v.t`.c IN (:xs_0, :xs_1)"
    assert leaf.params("a = {p} OR b = '{q}' OR c = {r}") == ["p", "r"]


def test_golden_sql_and_hash():
    c = compile_check(checks.load("patient-active-missing-nhi"))
    assert c.sql == (
        "SELECT `id`, `practice`, CASE WHEN __ready THEN CASE WHEN __failed THEN 'fail' WHEN NOT __failed THEN 'pass' ELSE 'indeterminate' END ELSE 'indeterminate' END AS tri_state\n"
        "FROM (\n  SELECT `clinic.patients`.`id`, `clinic.patients`.`practice`, ((active IS NOT NULL)) AS __ready, ((active = 1) AND (nhi IS NULL)) AS __failed\n"
        "  FROM clinic__patients AS `clinic.patients`\n)"
    )
    assert c == compile_check(checks.load("patient-active-missing-nhi")) and len(c.sql_hash) == 64


def test_arrays_are_fixed_and_full():
    bad = copy.deepcopy(checks.load("appointment-unknown-status").raw)
    bad["params"]["known_statuses"]["default"]["value"] = []
    with pytest.raises(CheckError, match="known_statuses"):
        compile_check(from_dict(bad))
    good = compile_check(checks.load("appointment-unknown-status"))
    assert good.params == {f"known_statuses_{i}": "string" for i in range(4)}


def test_fused_checks_share_a_clause():
    one = checks.load("appointment-completed-no-invoice")
    other = from_dict(doc(id="same-again", predicate=one.raw["predicate"]["all"][2]))
    assert compile_fused([one, other]).count("FROM clinic__appointments") == 1


def test_static_properties():
    assert can_be_indeterminate(checks.load("appointment-completed-no-invoice"))
    assert not can_be_indeterminate(from_dict(doc(prerequisites=[], predicate="status IS NULL")))
    assert default_params(checks.load("appointment-completed-no-invoice")) == {"invoice_lag_days": 7}
    assert len(ACTIONS) == 9
