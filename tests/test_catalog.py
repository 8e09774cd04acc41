from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from ledgerline.functions import text
from ledgerline.operators import catalog, lifecycle, policy, search
from ledgerline.operators.catalog import CatalogCriteria as C

T = datetime(2026, 1, 1, tzinfo=timezone.utc)


def test_keyword_scanner():
    parse = search.parse_keywords
    assert parse('" of " x') == ([" of ", "x"], "AND") and parse('a"b c"d') == (["a", "b c", "d"], "AND")
    assert parse('"" "AND" and OR b') == (["AND", "and", "b"], "OR") and parse("  ") == ([], "AND")
    for bad in ('"', "a AND b OR c"):
        with pytest.raises(search.SearchError):
            parse(bad)


def test_urls_and_folds(spark):
    urls = {"HTTPS://Ex.COM:0443/a?b#c": "https://ex.com/a?b", "http://h:80": "http://h", "http://h:8080/?": "http://h:8080/", "http://h:abc/": None, "http://h:99999/": None, "ftp://h/": None, "https://u:p@H:/x": "https://u:p@h/x", "http://[::1]:81/": "http://[::1]:81/", "http:///x": None}
    found = spark.createDataFrame([(u,) for u in urls], "u string").select("u", text.canonical_url(F.col("u")).alias("c")).collect()
    assert {r["u"]: r["c"] for r in found} == urls
    folds = [("Straße ΟΔΟΣ ﬁn ſo",)]
    assert spark.createDataFrame(folds, "t string").select(text.text_key(F.col("t"))).first()[0] == folds[0][0].casefold()
    safe = ["https://h/x", "ftp://h", "http://a@h", "http://h/ x", "https://"]
    assert [r[0] for r in spark.createDataFrame([(u,) for u in safe], "u string").select(text.safe_url(F.col("u"))).collect()] == ["https://h/x", None, None, None, None]


def test_policy_keeps_columns_and_normalises_once(spark):
    rows = spark.createDataFrame([("Nurse GROß", "x", "kept")], "title string, description string, _title string")
    found = policy.decide(rows, policy.Policy(title_exclude=("gross", "nurse"), description_include=("y",)), company=None)
    assert found.columns == ["title", "description", "_title", "reasons", "rejected"]
    assert [(r["field"], r["kind"], r["term"]) for r in found.first()["reasons"]] == [("title", "exclude_match", "gross"), ("title", "exclude_match", "nurse"), ("description", "no_include_match", None)]
    plan = found.filter("rejected")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("upper(") <= 4


def test_stale_against_a_plain_pass(spark):
    rows = [("ab"[k % 7 == 0], (k * 37) % 101, k * 3) for k in range(400)]
    newest, wanted = {}, []
    for s, at, place in rows:
        if at <= newest.get(s, -1):
            wanted.append((s, place))
        newest[s] = max(newest.get(s, -1), at)
    log = spark.createDataFrame(rows, "scope string, at int, place int")
    assert sorted((r["scope"], r["place"]) for r in lifecycle.stale(log, "place", ranges=13).collect()) == sorted(wanted)
    assert lifecycle.stale(log.filter("false"), "place").count() == 0


POSTINGS = [  # key, logical, source, title, company, description, location, active, outcome
    ("1", "A", "lever", "C++ Engineer", "Acme", "Writes a_b at 100%", "Berlin", True, "keep"),
    ("2", "A", "greenhouse", "Engineer", "acme", "python and café", None, True, "exclude"),
    ("3", "B", "lever", "Nurse", "Beta", "python", "Paris", True, "exclude"),
    ("4", "C", "greenhouse", "Clerk", "Zeta", "old python", "Rome", False, "keep"),
    ("5", "D", "lever", "analyst", "Delta", "", "paris, FR", True, "defer"),
    ("6", "D", "greenhouse", "Boss", "Delta", "x.y", None, False, "keep"),
    ("7", None, "lever", "Python dev", "None", "unlinked python", None, True, "keep"),
]


@pytest.fixture(scope="module")
def stored(spark):
    normal = [(s, "t", k, c, t, d, loc, "https://h/" + k, None, T.replace(day=int(k)) if k != "5" else None, "full_time" if k in "12" else None, "remote" if k == "3" else None, T) for k, _, s, t, c, d, loc, _, _ in POSTINGS]
    life = [(s, "t", k, "active" if a else "inactive", T.replace(day=int(k)), T.replace(day=10 + int(k)), None) for k, _, s, _, _, _, _, a, _ in POSTINGS]
    links = [(s, "t", k, g, T) for k, g, s, *_ in POSTINGS if g]
    keys = "source string, source_scope string, source_job_id string"
    return catalog.Catalog(
        spark.createDataFrame(normal, f"{keys}, company string, title string, description string, location string, job_url string, apply_url string, posted_at timestamp, employment_type string, workplace_type string, retrieved_at timestamp"),
        spark.createDataFrame(life, f"{keys}, status string, first_seen_at timestamp, last_seen_at timestamp, inactive_at timestamp"),
        spark.createDataFrame(links, f"{keys}, logical_job_id string, linked_at timestamp"),
        spark.createDataFrame([(s, "t", k, "{}") for k, _, s, *_ in POSTINGS], f"{keys}, payload_json string"),
    )


def judge(rows):
    known = F.create_map(*[F.lit(x) for k, *_, o in POSTINGS for x in (k, o)])
    return rows.withColumn("outcome", known[F.col("source_job_id")]).withColumn("reasons", F.array(F.lit("r")))


CASES = [
    (C(outcome="all"), "ABD"), (C(), "A"), (C(outcome="exclude"), "B"), (C(outcome="defer"), "D"),
    (C(keywords="python", outcome="all"), "AB"), (C(keywords="PYTHON café", outcome="all"), "A"), (C(keywords="CAFÉ", outcome="all"), ""),
    (C(keywords="engineer AND a_b", outcome="all"), "A"), (C(keywords="axb", outcome="all"), ""), (C(keywords="100%", outcome="all"), "A"), (C(keywords="c++", fields="title", outcome="all"), "A"),
    (C(keywords="nurse OR analyst", outcome="all"), "BD"), (C(keywords="nurse analyst", mode="OR", outcome="all"), "BD"), (C(keywords="delta", outcome="all"), ""), (C(keywords="delta", fields="all", outcome="all"), "D"),
    (C(keywords='"a_b at"', outcome="all"), "A"), (C(keywords="x.y", outcome="all"), ""), (C(keywords="x.y", include_inactive=True, outcome="all"), "D"),
    (C(keywords="old", include_inactive=True, outcome="all"), "C"), (C(keywords="old", include_inactive=True), ""), (C(keywords="old", include_inactive=True, outcome="exclude"), "C"),
    (C(source="greenhouse", outcome="all"), "A"), (C(company="ACM", outcome="all"), "A"), (C(location="PARIS", outcome="all"), "BD"), (C(location="paris", source="lever", keywords="nurse", outcome="all"), "B"),
    (C(employment_type="full_time", outcome="all"), "A"), (C(workplace_type="remote", outcome="all"), "B"), (C(discovered_since="2026-01-03T00:00:00+00:00", outcome="all"), "BD"),
]


def test_criteria(spark, stored):
    for criteria, wanted in CASES:
        found = catalog.search_catalog(stored, judge, criteria)
        assert "".join(sorted(r["id"] for r in found.matched.select("id").collect())) == wanted, criteria


def test_page(spark, stored):
    found = catalog.search_catalog(stored, judge, C(outcome="all", include_inactive=True, sort="title"))
    rows = found.page.collect()
    assert found.total.first()[0] == 4 and [r["id"] for r in rows] == ["D", "A", "C", "B"]
    a = next(r for r in rows if r["id"] == "A")
    assert (a["title"], a["outcome"], a["posted_at"].day, a["first_seen"].day, a["last_seen"].day) == ("C++ Engineer", "keep", 1, 1, 12)
    assert [(x["source"], x["outcome"]) for x in a["representations"]] == [("greenhouse", "exclude"), ("lever", "keep")]
    d = next(r for r in rows if r["id"] == "D")
    assert (d["title"], d["outcome"], d["posted_at"]) == ("analyst", "defer", None)
    orders = {"first_seen": "DCBA", "last_seen": "DCBA", "posted_newest": "BACD", "posted_oldest": "ABCD", "company": "ABDC"}
    for sort, wanted in orders.items():
        assert "".join(r["id"] for r in catalog.search_catalog(stored, judge, C(outcome="all", include_inactive=True, sort=sort)).page.collect()) == wanted
    assert catalog.search_catalog(stored, judge, C(outcome="all"), page=2).page.count() == 0
    assert [catalog.clamp_page(p, 51) for p in (0, 2, 9)] == [1, 2, 3] and catalog.clamp_page(4, 0) == 1
    for bad in (C(sort="x"), C(fields="x"), C(source="x"), C(outcome="x"), C(keywords='"'), C(discovered_since="x")):
        with pytest.raises(search.SearchError):
            catalog.search_catalog(stored, judge, bad)


def test_lists(stored):
    ids = lambda df: sorted(r["source_job_id"] for r in df.collect())
    assert ids(stored.unlinked()) == ["7"] and ids(stored.active()) == ["1", "2", "3", "5"] and ids(stored.screening_inputs()) == ids(stored.active())
    assert stored.get("lever", "t", "3").first()["logical_job_id"] == "B" and stored.get("x", "t", "3").count() == 0
    assert {r["logical_job_id"]: r["active"] for r in stored.has_active().collect()} == {"A": True, "B": True, "C": False, "D": True}
