import json
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from ledgerline.functions import html
from ledgerline.operators import metadata, normalise

T = datetime(2026, 6, 1, tzinfo=timezone.utc)


def test_lines():
    assert html.plain_lines("\n a  b \n\n\n c\t\n ") == "a b\n\nc" and html.plain_lines("a\n\nb", blanks=False) == "a\nb"
    assert html.html_lines("<h5>H</h5><blockquote>q</blockquote>", html.LEVER) == "H\n\nq"
    twice = "&amp;lt;p&amp;gt;a &amp;amp;lt; b&amp;lt;/p&amp;gt;"
    assert html.html_lines(html.unescaped(twice), html.GREENHOUSE, False) == "a < b"
    assert html.html_lines("<style>x</style><p>1</p><script>y</script><li>2</li>", html.GREENHOUSE, False) == "1\n- 2"


def rows_of(spark, *payloads):
    made = [("s", "Acme", T, p if isinstance(p, str) else json.dumps(p)) for p in payloads]
    return spark.createDataFrame(made, "source_scope string, company string, retrieved_at timestamp, payload_json string")


def test_lever(spark):
    base = {"id": " 1 ", "text": " Engineer ", "hostedUrl": "https://h/1", "applyUrl": "", "categories": {"location": " Berlin "}, "descriptionPlain": " a  b\n\n\nc ", "lists": [{"text": "Do", "content": "<li>x</li><li>y &amp; z</li>"}, {"text": "", "content": ""}], "additionalPlain": "end"}
    bare = {"id": "2", "text": "T", "hostedUrl": "https://h/2", "descriptionBody": "<div>body</div>"}
    got = normalise.lever(rows_of(spark, base, bare, {"id": 3, "text": " ", "hostedUrl": "u", "categories": [], "lists": {}}, "[1]", "{")).collect()
    assert (got[0]["source_job_id"], got[0]["title"], got[0]["location"], got[0]["apply_url"], got[0]["violations"]) == ("1", "Engineer", "Berlin", None, [])
    assert got[0]["description"] == "a b\n\nc\n\nDo\n- x\n- y & z\n\nend" and (got[1]["description"], got[1]["location"]) == ("body", None)
    assert got[2]["violations"] == ["id", "title", "job_url", "categories", "lists"] and "payload" in got[3]["violations"] and "payload" in got[4]["violations"]


def test_greenhouse_and_snapshots(spark):
    good = {"id": 7, "title": "T", "absolute_url": "https://h", "content": "&lt;p&gt;a&lt;/p&gt;", "location": {"name": "Rome"}}
    got = normalise.greenhouse(rows_of(spark, good, good | {"id": True}, good | {"id": -1, "location": "x"}, good | {"id": "8", "content": 5})).collect()
    assert (got[0]["source_job_id"], got[0]["description"], got[0]["location"], got[0]["violations"]) == ("7", "a", "Rome", [])
    assert [r["violations"] for r in got[1:]] == [["id"], ["id", "location"], ["id", "content"]]
    both = normalise.greenhouse(rows_of(spark, good, good)).unionByName(normalise.greenhouse(rows_of(spark, good).withColumn("source_scope", F.lit("t"))))
    whole, failed = normalise.snapshots(both)
    assert [r["source_scope"] for r in whole.collect()] == ["t"] and [tuple(r) for r in failed.collect()] == [("greenhouse", "s", ["repeated_id"])]


def found(spark, source, payload, **options):
    r = metadata.extract(rows_of(spark, payload).withColumn("source", F.lit(source)), **options).first()
    return r["found_employment_type"], r["found_workplace_type"], r["found_posted_at"] and r["found_posted_at"].replace(tzinfo=None).isoformat()


def gh(*fields, **more):
    return {"metadata": [{"name": n, "value": v} for n, v in fields]} | more


def test_metadata(spark):
    assert found(spark, "lever", {"categories": {"commitment": " Full-Time "}, "workplaceType": "On_site", "createdAt": 1_700_000_000_000})[:2] == ("full_time", "onsite")
    assert found(spark, "lever", {"categories": {"commitment": "Gig"}}, lever_aliases={"gig": "contract"})[0] == "contract"
    for bad in (True, "1700000000000", 946_684_799_999, 4_102_444_800_000, None, 1_900_000_000_000):
        assert found(spark, "lever", {"createdAt": bad})[2] is None
    assert found(spark, "greenhouse", {"first_published": "2026-05-01T10:00:00-04:00"})[2] == "2026-05-01T14:00:00"
    assert found(spark, "greenhouse", {"first_published": "2026-05-01T10:00:00"})[2] is None
    assert found(spark, "greenhouse", gh(("Time  Type", "Full time"), ("employment type", "full_time"), ("Other", "intern")))[0] == "full_time"
    assert found(spark, "greenhouse", gh(("time type", "full time"), ("employment type", "intern")))[0] is None
    assert found(spark, "greenhouse", gh(("hours", "FT")), employment_fields={"hours": {"ft": "full_time"}})[0] == "full_time"
    assert found(spark, "greenhouse", gh(("workplace type", ["Remote", "remote"])))[1] == "remote"
    assert found(spark, "greenhouse", gh(("workplace type", ["Remote", "odd"]), ("workplace type", "remote")))[1] is None
    assert found(spark, "greenhouse", gh(("workplace type", []), ("workplace type", "hybrid")))[1] == "hybrid"
    assert found(spark, "elsewhere", gh(("workplace type", "remote"))) == (None, None, None)


def test_backfill(spark):
    rows = rows_of(spark, {"categories": {"commitment": "intern"}}, {"workplaceType": "remote"}, "nonsense").withColumns({"source": F.lit("lever"), "employment_type": F.lit("full_time").cast("string"), "workplace_type": F.lit(None).cast("string"), "posted_at": F.lit(None).cast("timestamp")})
    extracted = metadata.extract(rows)
    assert [(r["employment_type"], r["workplace_type"]) for r in metadata.backfill(extracted).collect()] == [("full_time", None), ("full_time", "remote"), ("full_time", None)]
    r = metadata.backfill_counters(extracted).first()
    assert (r["total"], r["invalid_payload"], r["workplace_type_enriched"], r["workplace_type_populated"], r["workplace_type_missing"], r["employment_type_enriched"], r["posted_at_missing"]) == (3, 1, 1, 1, 1, 0, 2)
    assert metadata.disagreements(extracted).count() == 3
    with pytest.raises(ValueError):
        metadata.backfill(extracted, ())
