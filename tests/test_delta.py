import random
from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from ledgerline.operators import catalog, delta, judging, policy, store

DAY = datetime(2024, 1, 1, tzinfo=UTC)
RULES = policy.Policy(title_exclude=("director",))
POSTING = "source string, source_scope string, source_job_id string, company string, title string, description string, location string, job_url string, apply_url string, payload_json string"
KEY = "source string, source_scope string, source_job_id string"


def post(spark, kept, day, rows):
    made = [("a", c, i, "Acme", t, d, None, f"https://h/{i}", None, p) for c, i, t, d, p in rows]
    heads = spark.createDataFrame([("a", c, DAY + timedelta(days=day)) for c in sorted({r[0] for r in rows})], "source string, source_scope string, retrieved_at timestamp")
    kept.reconcile(spark.createDataFrame(made, POSTING), heads)


def link(spark, kept, *found):
    kept.assign(spark.createDataFrame([("a", c, i, logical, DAY) for c, i, logical in found], KEY + ", logical_job_id string, linked_at timestamp"))


def rebuilt(kept, rules):
    """All that a sync must have: decisions and entities computed from the tables alone."""
    whole = kept.catalog()
    every = judging.judge(whole, rules)(whole.postings())
    return (
        {tuple(r[:4]): (r["outcome"], r["reasons"], r["status"], r["last_seen_at"]) for r in every.select(*catalog.KEYS, "logical_job_id", "outcome", "reasons", "status", "last_seen_at").collect()},
        {r["id"]: (r["title"], r["outcome"], r["first_seen"], r["last_seen"]) for r in catalog.entities(every).collect()},
    )


def stored(kept):
    return (
        {tuple(r[:4]): (r["outcome"], r["reasons"], r["status"], r["last_seen_at"]) for r in kept.table("judged").select(*catalog.KEYS, "logical_job_id", "outcome", "reasons", "status", "last_seen_at").collect()},
        {r["id"]: (r["title"], r["outcome"], r["first_seen"], r["last_seen"]) for r in kept.table("entities").collect()},
    )


@pytest.fixture(scope="module")
def kept(spark, tmp_path_factory):
    return store.Store(spark, f"file://{tmp_path_factory.mktemp('s')}/s").create()


def test_each_kind_of_change(spark, kept):
    base = [("x", "1", "Clerk", "d1", '{"k": 1}'), ("x", "2", "Director", "d2", '{"k": 2}'), ("y", "3", "Clerk", "d3", '{"k": 3}')]
    post(spark, kept, 1, base)
    link(spark, kept, ("x", "1", "A"), ("x", "2", "A"), ("y", "3", "B"))
    steps = [("built", lambda: None, (3, 3, 3, 0, 0)), ("nothing", lambda: None, (3, 0, 0, 0, 0))]

    def fill():
        old = kept.table("normalized", [("a", "y")])
        kept._overwrite("normalized", spark.createDataFrame(old.withColumn("employment_type", F.lit("full_time")).collect(), old.schema))

    def reassign():
        old = kept.table("links", [("a", "y")])
        kept._overwrite("links", spark.createDataFrame(old.withColumn("logical_job_id", F.lit("A")).collect(), old.schema))

    steps += [
        ("retrieved again", lambda: post(spark, kept, 2, base), (3, 0, 0, 3, 0)),
        ("text", lambda: post(spark, kept, 3, [*base[:2][:1], ("x", "2", "Director", "new", '{"k": 2}')]), (3, 1, 1, 2, 0)),
        ("payload", lambda: post(spark, kept, 4, [("y", "3", "Clerk", "d3", '{"k": 4}')]), (3, 0, 1, 1, 0)),
        ("new", lambda: (post(spark, kept, 5, [("z", "4", "Cook", "d4", '{"k": 5}')]), link(spark, kept, ("z", "4", "C"))), (4, 1, 1, 0, 0)),
        ("inactive", lambda: post(spark, kept, 6, [("x", "1", "Clerk", "d1", '{"k": 1}')]), (4, 0, 0, 2, 0)),
        ("metadata", fill, (4, 0, 0, 1, 0)),
        ("entity", reassign, (4, 0, 1, 1, 0)),
        ("deleted", lambda: kept.delete(spark.createDataFrame([("a", "z", "4")], KEY)), (3, 0, 0, 0, 1)),
    ]
    for name, change, wanted in steps:
        change()
        got = delta.synchronize(kept, RULES)
        assert (got.scanned, got.text, got.screened, got.metadata_updated, got.deleted) == wanted, name
        assert stored(kept) == rebuilt(kept, RULES), name
    other = policy.Policy(title_exclude=("clerk",))
    got = delta.synchronize(kept, other)
    assert (got.text, got.screened, got.deleted) == (0, 3, 0) and stored(kept) == rebuilt(kept, other)
    assert not delta.synchronize(kept, other).changed
    assert [r["id"] for r in delta.search(kept, catalog.CatalogCriteria(keywords="clerk", outcome="all", include_inactive=True)).collect()] == ["A"]


def test_a_failed_attempt_is_made_good(spark, kept, monkeypatch):
    rules, whole = policy.Policy(title_exclude=("nobody",)), store.Store.replace
    for broken in ("entities", "judged"):
        def fails(self, name, before, after, broken=broken):
            if name == broken:
                raise OSError("lost")
            whole(self, name, before, after)

        monkeypatch.setattr(store.Store, "replace", fails)
        with pytest.raises(OSError):
            delta.synchronize(kept, rules)
    monkeypatch.setattr(store.Store, "replace", whole)
    assert delta.synchronize(kept, rules).screened == 3 and stored(kept) == rebuilt(kept, rules)
