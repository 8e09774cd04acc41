import pytest

from ledgerline.operators import identity, lifecycle, outcomes, policy, search


def test_keywords():
    assert search.parse_keywords('a "b c" OR d') == (["a", "b c", "d"], "OR")
    assert search.parse_keywords('"AND" x') == (["AND", "x"], "AND")
    for bad in ("a AND b OR c", 'open "quote'):
        with pytest.raises(search.SearchError):
            search.parse_keywords(bad)


def test_reconcile(spark):
    state = spark.createDataFrame([("s", "a", "active", 1, 1, None), ("s", "b", "inactive", 1, 1, 2), ("t", "c", "active", 1, 1, None)], "scope string, id string, status string, first_seen int, last_seen int, inactive_at int")
    rows, headers = spark.createDataFrame([("s", "b"), ("s", "d")], "scope string, id string"), spark.createDataFrame([("s", 3)], "scope string, at int")
    found = {r["id"]: tuple(r)[2:] for r in lifecycle.reconcile(state, rows, headers).collect()}
    assert found == {"a": ("inactive", 1, 1, 3), "b": ("active", 1, 3, None), "d": ("active", 3, 3, None), "c": ("active", 1, 1, None)}
    empty = {r["id"]: r["status"] for r in lifecycle.reconcile(state, rows.filter("false"), headers).collect()}
    assert empty == {"a": "inactive", "b": "inactive", "c": "active"}


def test_outcomes(spark):
    rows = spark.createDataFrame([("x", "keep"), ("x", "exclude"), ("y", "defer")], "logical_id string, outcome string")
    assert {tuple(r) for r in outcomes.by_logical(rows).collect()} == {("x", "keep"), ("y", "defer")}


def test_policy(spark):
    p = policy.Policy(title_exclude=("dispatcher", "nurse"), company_exclude=("Acme  Inc",), description_include=("python",))
    rows = spark.createDataFrame([(1, "IT Dispatcher", "Acme inc", "Python"), (2, "Night nurse", "Other", "none"), (3, "Engineer", "Other", "PYTHON")], "id int, title string, company string, description string")
    found = {r["id"]: (r["rejected"], [(x["field"], x["kind"]) for x in r["reasons"]]) for r in policy.decide(rows, p).collect()}
    assert found == {1: (True, [("company", "exclude_match")]), 2: (True, [("title", "exclude_match"), ("description", "no_include_match")]), 3: (False, [])}
    with pytest.raises(policy.PolicyError):
        policy.parse_policy(b"version = 2")


def test_identity_is_sequential(spark):
    rows = [("s", "x", "1", "A", "https://h.example:443/j", None, "L1"), ("s", "x", "2", "a ", "HTTPS://H.example/j#f", None, None), ("s", "x", "3", "B", "https://h.example/j", None, None), ("s", "x", "4", "a", None, "https://h.example/j", None)]
    found = {r["id"]: (r["logical_id"], r["matched"]) for r in identity.resolve(spark.createDataFrame(rows, "source string, scope string, id string, company string, job_url string, apply_url string, logical_id string")).collect()}
    assert found["2"] == ("L1", True) and not found["3"][1] and not found["4"][1]
    assert found["3"][0] == identity.new_id("s", "x", "3") and found["4"][0] == identity.new_id("s", "x", "4")
