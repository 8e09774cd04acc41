import pytest
from pyspark.sql import functions as F

from ledgerline.operators import catalog, judging, outcomes, policy, report

KEYS = ["source", "source_scope", "source_job_id"]


def test_representative_of_an_inactive_first_and_an_excluded_second(spark):
    """Neither counts more than the other, so the first key does; a kept one counts more than both."""
    rows = [("A", 1, "first", "inactive", "keep"), ("A", 2, "second", "active", "exclude"), ("B", 1, "first", "inactive", "keep"), ("B", 2, "second", "active", "exclude"), ("B", 3, "third", "active", "defer"), ("C", 1, "first", "active", "odd"), ("C", 2, "second", "active", "keep"), ("C", 3, "third", "active", "keep"), ("D", 1, "first", "inactive", "keep")]
    made = spark.createDataFrame(rows, "logical_id string, k int, title string, status string, outcome string").withColumns({"first_seen": F.col("k"), "last_seen": F.col("k"), "posted_at": F.col("k")})
    got = {r["logical_id"]: (r["title"], r["outcome"], r["posted_at"]) for r in outcomes.summary(made, ["k"]).collect()}
    assert got == {"A": ("first", "exclude", 2), "B": ("third", "defer", 2), "C": ("second", "keep", 1), "D": ("first", "exclude", None)}
    ranked = outcomes.representative(made.withColumn("p", outcomes.active_priority(F.col("status"), F.col("outcome"))), [F.desc("p"), F.asc("k")])
    assert {r["logical_id"]: r["title"] for r in ranked.collect()} == {k: v[0] for k, v in got.items()}
    postings = made.select(F.lit("s").alias("source"), F.lit("t").alias("source_scope"), F.col("k").alias("source_job_id"), "title", F.lit("c").alias("company"), "status", "outcome", F.col("k").alias("first_seen_at"), F.col("k").alias("last_seen_at"), "posted_at", F.col("logical_id").alias("logical_job_id"))
    assert {r["id"]: (r["title"], r["outcome"], r["posted_at"]) for r in catalog.entities(postings).collect()} == got


RULES = policy.Policy(title_exclude=("director",), description_include=("work",))
POSTINGS = [  # key, logical id, status, title, location, description, payload; outcome, reasons
    ("1", "A", "active", "Clerk", "Boston", "Fine work", None, "keep", "geo_h:pass:US_or_worldwide_work_option"),
    ("2", "A", "active", "Director", "Boston", "Fine work", None, "exclude", "filter:title/exclude_match, geo_h:pass:US_or_worldwide_work_option"),
    ("3", "B", "active", "Clerk", "Lima, Peru", "Fine work", None, "exclude", "geo_h:exclude:structured_foreign_work_location"),
    ("4", "B", "inactive", "Clerk", "Boston", "Fine work", None, "keep", "geo_h:pass:US_or_worldwide_work_option"),
    ("5", "C", "active", "Clerk", None, "", None, "exclude", "filter:description/no_include_match, insufficient_description, geo_h:review_only:unknown_work_eligibility"),
    ("6", "D", "active", "Cashier", None, "You work the register", None, "exclude", "retail_store_operations, geo_h:review_only:unknown_work_eligibility"),
    ("7", "E", "active", "Clerk", "Cork", "Fine work", '{"country": "IE"}', "exclude", "geo_h:exclude:corroborated_foreign_city"),
    ("8", "F", "active", "Clerk", "Cork", "Fine work", "no json", "keep", "geo_h:review_only:insufficient_location_confidence"),
]


@pytest.fixture(scope="module")
def whole(spark):
    source = lambda p: "lever" if p else "greenhouse"
    normal = spark.createDataFrame([(source(p), "x", k, "Acme", t, d, at, "https://a.b/c", None, None, None, None) for k, _, _, t, at, d, p, _, _ in POSTINGS], "source string, source_scope string, source_job_id string, company string, title string, description string, location string, job_url string, apply_url string, posted_at timestamp, employment_type string, workplace_type string")
    state = spark.createDataFrame([(source(p), "x", k, s) for k, _, s, _, _, _, p, _, _ in POSTINGS], "source string, source_scope string, source_job_id string, status string").withColumns({"first_seen_at": F.timestamp_seconds(F.lit(5)), "last_seen_at": F.timestamp_seconds(F.lit(9))})
    links = spark.createDataFrame([(source(p), "x", k, i) for k, i, _, _, _, _, p, _, _ in POSTINGS], "source string, source_scope string, source_job_id string, logical_job_id string")
    raw = spark.createDataFrame([(source(p), "x", k, p or "{}") for k, _, _, _, _, _, p, _, _ in POSTINGS], "source string, source_scope string, source_job_id string, payload_json string")
    return catalog.Catalog(normal, state, links, raw)


def test_judged_catalog(whole):
    every = judging.judge(whole, RULES)(whole.postings().withColumn("outcome", F.lit("clash")))
    got = {r["source_job_id"]: (r["outcome"], ", ".join(r["reasons"])) for r in every.collect()}
    assert got == {p[0]: p[7:] for p in POSTINGS}
    screened = judging.screen_catalog(whole, RULES)
    assert {tuple(r) for r in judging.logical_outcomes(screened).collect()} == {("A", "keep"), ("B", "exclude"), ("C", "exclude"), ("D", "exclude"), ("E", "exclude"), ("F", "keep")}
    assert {r["logical_job_id"]: r["first_posting"]["source_job_id"] for r in judging.eligible(screened).collect()} == {"A": "1", "B": "3", "D": "6", "E": "7", "F": "8"}
    by = {r["source_job_id"]: r for r in screened.collect()}
    assert [by[k]["geography"] for k in ("1", "3", "8")] == ["us", "foreign_only", "uncertain"]
    evidence = [tuple(e) for e in by["7"]["evidence"]]
    assert evidence[:5] == [("geo_h.action", "exclude"), ("geo_h.assessment", "exclude"), ("geo_h.reason", "corroborated_foreign_city"), ("geo_h.confidence", "high"), ("geo_h.work_mode", "unspecified")]
    assert ("geo_h.location", "Cork") in evidence and ("geo_h.raw.country", "IE") in evidence and ("geo_h.country", "Ireland") in evidence
    masks = judging.category_masks(("retail_store_operations", "food_service_operations"))
    assert tuple(report.funnel(screened.filter("not rejected"), F.col("logical_job_id"), masks).first()) == (5, 1, 0, 4)


def test_search_keeps_what_is_judged_to_be_kept(whole):
    search = lambda **c: {r["id"]: r["outcome"] for r in catalog.search_catalog(whole, judging.judge(whole, RULES), catalog.CatalogCriteria(**c)).matched.collect()}
    assert search(keywords="work") == {"A": "keep", "F": "keep"}
    assert search(keywords="work", outcome="exclude") == {"B": "exclude", "D": "exclude", "E": "exclude"}
    assert search(keywords="director", outcome="all", fields="title") == {"A": "keep"}
    page = catalog.search_catalog(whole, judging.judge(whole, RULES), catalog.CatalogCriteria(keywords="boston", fields="all", outcome="all")).page.collect()
    assert [(r["id"], len(r["representations"])) for r in page] == [("A", 2)]


def test_many_terms_are_few_terms(spark, monkeypatch):
    """One pass for all terms gives the reasons that one search for each gives, nulls and terms with one key included."""
    terms = tuple(f"{a}{b}" for a in ("ab", "Straße", "x  y", "AB", "bc", "c") for b in ("", "c", " d", "ß", "E"))
    rules = policy.Policy(title_exclude=("dispatcher", *terms), title_include=("it", "ab"), company_exclude=("acme",), description_exclude=terms, description_include=terms[3:20])
    texts = ["", None, "abcd", "STRASSE  ss", "x\ty e", "IT dispatcher", "it  Dispatcher ", "nothing", "abc" * 5000, "bce c d"]
    rows = spark.createDataFrame([(k, a, "Acme" if k % 3 else None, b) for k, (a, b) in enumerate((a, b) for a in texts for b in texts)], "k int, title string, company string, description string").withColumn("reasons", F.lit("clash"))
    fast = {r["k"]: (r["reasons"], r["rejected"]) for r in policy.decide(rows, rules).collect()}
    monkeypatch.setattr(policy, "MANY", 10_000)
    assert {r["k"]: (r["reasons"], r["rejected"]) for r in policy.decide(rows, rules).collect()} == fast
