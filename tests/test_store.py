import json
import random
from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from ledgerline.operators import lifecycle, normalise, rows, store

KEYS = ["source", "source_scope", "source_job_id"]
DAY = datetime(2024, 1, 1, tzinfo=UTC)
POSTING = "source string, source_scope string, source_job_id string, company string, title string, description string, location string, job_url string, apply_url string, payload_json string"


def made(spark, keys, text="d"):
    return spark.createDataFrame([(s, c, str(i), "Acme", f"t{i}", text, None, f"https://h/{i}", None, '{"id": 1}') for s, c, i in keys], POSTING)


def headers(spark, *found):
    return spark.createDataFrame([(s, c, DAY + timedelta(days=d)) for s, c, d in found], "source string, source_scope string, retrieved_at timestamp")


def states(kept):
    return {tuple(r[k] for k in KEYS): (r["status"], *((r[c] and (r[c].replace(tzinfo=None) - DAY.replace(tzinfo=None)).days) for c in ("first_seen_at", "last_seen_at", "inactive_at"))) for r in kept.table("lifecycle").collect()}


@pytest.fixture
def kept(spark, tmp_path):
    return store.Store(spark, f"file://{tmp_path}/s").create()


def test_snapshots(spark, kept):
    assert kept.table("normalized").count() == 0 and kept.create().table("links").count() == 0
    assert kept.reconcile(made(spark, [("a", "x 1/2", 1), ("a", "x 1/2", 2), ("b", "y", 1)]), headers(spark, ("a", "x 1/2", 1), ("b", "y", 1))) == 3
    assert kept.reconcile(made(spark, [("a", "x 1/2", 2), ("a", "x 1/2", 3)], "new"), headers(spark, ("a", "x 1/2", 2))) == 2
    assert states(kept) == {("a", "x 1/2", "1"): ("inactive", 1 - 0, 1, 2), ("a", "x 1/2", "2"): ("active", 1, 2, None), ("a", "x 1/2", "3"): ("active", 2, 2, None), ("b", "y", "1"): ("active", 1, 1, None)}
    texts = {r["source_job_id"]: (r["description"], r["retrieved_at"].day) for r in kept.table("normalized").filter("source = 'a'").collect()}
    assert texts == {"1": ("d", 2), "2": ("new", 3), "3": ("new", 3)} and kept.table("raw").count() == 4
    assert kept.reconcile(made(spark, []), headers(spark, ("a", "x 1/2", 5), ("c", "none", 5))) == 0
    assert states(kept)["a", "x 1/2", "1"] == ("inactive", 1, 1, 2) and states(kept)["a", "x 1/2", "3"] == ("inactive", 2, 2, 5)
    assert {tuple(r)[:2] for r in kept.table("scope_state").collect()} == {("a", "x 1/2"), ("b", "y"), ("c", "none")}
    before = states(kept)
    for day in (4, 5):
        with pytest.raises(store.StoreError, match="not newer"):
            kept.reconcile(made(spark, [("a", "x 1/2", 9)]), headers(spark, ("a", "x 1/2", day), ("b", "y", 9)))
    assert kept.reconcile(made(spark, [("a", "x 1/2", 9), ("b", "y", 1)]), headers(spark, ("a", "x 1/2", 5), ("b", "y", 9)), stale="skip") == 1
    assert {k: v for k, v in states(kept).items() if k[0] == "a"} == {k: v for k, v in before.items() if k[0] == "a"} and states(kept)["b", "y", "1"] == ("active", 1, 9, None)


def test_what_is_refused(spark, kept):
    good = made(spark, [("a", "x", 1)])
    for rows_, heads, message in (
        (good.unionAll(good), [("a", "x", 1)], "twice"), (good, [("a", "y", 1)], "no header"), (good, [("a", "x", 1), ("a", "x", 2)], "several headers"),
        (good.withColumn("job_url", F.lit("ftp://x y")), [("a", "x", 1)], "job_url"), (good.withColumn("payload_json", F.lit("[1]")), [("a", "x", 1)], "raw.payload_json"), (good.withColumn("title", F.lit(" ")), [("a", "x", 1)], "title"),
    ):
        with pytest.raises(store.StoreError, match=message):
            kept.reconcile(rows_, headers(spark, *heads))
    assert kept.table("normalized").count() == kept.table("scope_state").count() == 0


def test_a_failed_attempt_is_repeated(spark, kept, monkeypatch):
    kept.reconcile(made(spark, [("a", "x", 1), ("a", "x", 2)]), headers(spark, ("a", "x", 1)))
    whole = store.Store._overwrite
    for broken in ("normalized", "lifecycle", "scope_state"):
        def fails(self, name, df, broken=broken):
            if name == broken:
                raise OSError("lost")
            whole(self, name, df)

        monkeypatch.setattr(store.Store, "_overwrite", fails)
        with pytest.raises(OSError):
            kept.reconcile(made(spark, [("a", "x", 2), ("a", "x", 3)]), headers(spark, ("a", "x", 2)))
    monkeypatch.setattr(store.Store, "_overwrite", whole)
    kept.reconcile(made(spark, [("a", "x", 2), ("a", "x", 3)]), headers(spark, ("a", "x", 2)))
    assert states(kept) == {("a", "x", "1"): ("inactive", 1, 1, 2), ("a", "x", "2"): ("active", 1, 2, None), ("a", "x", "3"): ("active", 2, 2, None)}


def test_a_log_snapshot_by_snapshot_is_its_replay(spark, kept):
    rng = random.Random(5)
    log = sorted({(rng.choice("xy"), rng.randrange(8), day) for day in range(1, 6) for _ in range(7)}, key=lambda e: e[2])
    for day in range(1, 6):
        now = [e for e in log if e[2] == day]
        kept.reconcile(made(spark, [("a", c, i) for c, i, _ in now]), headers(spark, *{("a", c, day) for c, _, _ in now}))
    frame = spark.createDataFrame([(c, str(i), DAY + timedelta(days=d)) for c, i, d in log], "scope string, id string, at timestamp")
    wanted = {("a", r["scope"], r["id"]): tuple(r[c] for c in ("status", "first_seen", "last_seen", "inactive_at")) for r in lifecycle.replay(frame).collect()}
    got = {tuple(r[k] for k in KEYS): tuple(r[c] for c in ("status", "first_seen_at", "last_seen_at", "inactive_at")) for r in kept.table("lifecycle").collect()}
    assert got == wanted
    seen = store.checkpoints(spark.createDataFrame([("a", c, DAY + timedelta(days=d)) for c, _, d in log], "source string, source_scope string, retrieved_at timestamp"))
    assert {tuple(r) for r in seen.collect()} == {tuple(r) for r in kept.table("scope_state").collect()}


def test_links_and_deletion(spark, kept):
    kept.reconcile(made(spark, [("a", "x", 1), ("a", "x", 2), ("b", "y=1", 1)]), headers(spark, ("a", "x", 1), ("b", "y=1", 1)))
    link = lambda *found: spark.createDataFrame([(s, c, i, logical, DAY + timedelta(days=d)) for s, c, i, logical, d in found], "source string, source_scope string, source_job_id string, logical_job_id string, linked_at timestamp")
    ids = lambda df: {tuple(r[k] for k in KEYS): r["logical_job_id"] for r in df.collect()}
    assert ids(kept.assign(link(("a", "x", "1", "L1", 2), ("a", "x", "1", "L0", 1)))) == {("a", "x", "1"): "L0"}
    assert ids(kept.assign(link(("a", "x", "1", "L9", 0), ("b", "y=1", "1", "L1", 3)))) == {("a", "x", "1"): "L0", ("b", "y=1", "1"): "L1"}
    with pytest.raises(store.StoreError, match="no such posting: a/x/7"):
        kept.assign(link(("a", "x", "7", "L1", 0), ("a", "x", "2", "L1", 0)))
    assert kept.table("links").count() == 2 and kept.catalog().unlinked().count() == 1
    kept.delete(spark.createDataFrame([("a", "x", "1"), ("b", "y=1", "1"), ("q", "q", "q")], "source string, source_scope string, source_job_id string"))
    assert [kept.table(n).count() for n in ("raw", "normalized", "lifecycle", "links", "scope_state")] == [1, 1, 1, 0, 2]
    assert [r["source_job_id"] for r in kept.catalog().normalized.collect()] == ["2"]


def test_stored_rows_are_checked_when_they_are_read(spark, kept):
    kept.reconcile(made(spark, [("a", "x", 1)]), headers(spark, ("a", "x", 1)))
    bad = kept.table("lifecycle").withColumn("inactive_at", F.col("last_seen_at"))
    kept._overwrite("lifecycle", bad.checkpoint() if spark.sparkContext.getCheckpointDir() else spark.createDataFrame(bad.collect(), bad.schema))
    with pytest.raises(Exception, match="stored state a/x/1: inactive_at"):
        kept.catalog().lifecycle.collect()


def test_row_checks(spark):
    urls = {"https://h": True, "HTTP://h/x?y": True, "ftp://h": False, "https:///x": False, "https://h/a b": False, "https://h/ ": False, "": False, None: False, "//h": False, "https://?x": False}
    got = spark.createDataFrame([(u,) for u in urls], "u string").select("u", rows.web_url(F.col("u")).alias("ok")).collect()
    assert {r["u"]: r["ok"] for r in got} == urls
    payloads = [("{}", ["payload_json"]), ('{"a": 1}', []), ("[1]", ["payload_json"]), ("x", ["payload_json"]), (None, ["payload_json"])]
    found = spark.createDataFrame([("s", "c", str(k), p, DAY) for k, (p, _) in enumerate(payloads)], "source string, source_scope string, source_job_id string, payload_json string, retrieved_at timestamp").select("source_job_id", rows.payload_violations().alias("v"))
    assert {r["source_job_id"]: r["v"] for r in found.collect()} == {str(k): v for k, (_, v) in enumerate(payloads)}


def test_odd_payloads_are_violations(spark):
    base = {"id": "1", "text": "T", "hostedUrl": "https://h/1", "descriptionPlain": "d"}
    cases = [({}, []), ({"hostedUrl": "ftp://x y"}, ["job_url"]), ({"applyUrl": "mailto:x"}, ["bad_apply_url"]), ({"lists": [{"text": 5, "content": "x"}]}, ["list_member"]), ({"lists": ["x"]}, ["list_member"]), ({"lists": [{"text": None}, {}]}, []), ({"descriptionPlain": None, "descriptionBody": 7}, ["body"]), ({"descriptionBody": 7}, [])]
    frame = spark.createDataFrame([("x", "Acme", DAY, json.dumps(base | c)) for c, _ in cases], "source_scope string, company string, retrieved_at timestamp, payload_json string")
    assert [r["violations"] for r in normalise.lever(frame).collect()] == [v for _, v in cases]
    one = spark.createDataFrame([("x", "Acme", DAY, '{"id": 1, "title": "T", "absolute_url": "nowhere"}')], frame.schema)
    assert normalise.greenhouse(one).first()["violations"] == ["job_url"]
