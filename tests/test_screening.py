import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.sql import functions as F

from ledgerline.operators import occupation, report, screening
from ledgerline.sources import http, registry

TITLES = [  # title, description, reasons
    ("Cashier", "You will process transactions. Smile", ["retail_store"]),
    ("Cashier", "You will not process transactions", []),
    ("Software Cashier", "process transactions", []),
    ("Store manager", "Design and build software", []),
    ("Store manager", "- run our store!", ["retail_store"]),
    ("Registered Nurse", "Provide excellent patient care\nNo nights", ["direct_clinical_care"]),
    ("Shift Lead", "open the store. Bake fresh cookies", ["retail_store", "food_preparation_or_service"]),
    ("Survey taker", "Complete paid surveys. Earn extra income", ["paid_poll_or_survey"]),
    ("Survey taker", "Complete paid surveys as part of the application. Earn money", []),
    ("Survey taker", "Complete surveys", []),
    ("Accountant", "process transactions", []),
]


def test_occupations_and_screening(spark):
    rows = spark.createDataFrame([(k, t, d) for k, (t, d, _) in enumerate(TITLES)] + [(50, "X", None), (51, "X", " N/A "), (52, "X", "This is a test posting, please do not apply"), (53, None, "fine")], "k int, title string, description string")
    got = {r["k"]: [o["reason"] for o in r["occupations"]] for r in occupation.with_occupations(rows).collect()}
    names = dict(zip(("paid_poll_or_survey", "retail_store", "direct_clinical_care", "food_preparation_or_service"), occupation.REASONS))
    assert got == {k: [names[x] for x in r] for k, (_, _, r) in enumerate(TITLES)} | {50: [], 51: [], 52: [], 53: []}
    done = {r["k"]: r["screening"] for r in screening.screen(rows).collect()}
    assert [done[k]["outcome"] for k in (0, 1, 50, 51, 52, 53)] == ["exclude", "keep", "defer", "defer", "exclude", "keep"]
    assert [(e["field"], e["value"]) for e in done[0]["evidence"]] == [("title", "Cashier"), ("description", "You will process transactions")]
    assert done[52]["reasons"] == ["explicit_testing_do_not_apply"] and done[51]["reasons"] == ["insufficient_description"]


def test_enforcement(spark):
    cases = [("exclude", "explicit_foreign_employee_location", "high", [], [], [], "exclude"), ("exclude", "other", "high", [], [], [], "review_only"), ("exclude", "explicit_foreign_employee_location", "medium", [], [], [], "review_only"), ("exclude", "explicit_foreign_employee_location", "high", ["c"], [], [], "review_only"), ("exclude", "explicit_foreign_employee_location", "high", [], [], ["US"], "review_only"), ("keep", "x", "low", [], [], [], "pass"), ("keep", "x", "high", [], ["u"], [], "review_only"), ("defer", "x", "high", [], [], [], "review_only")]
    rows = spark.createDataFrame([(c[:6], c[6]) for c in cases], "a struct<outcome:string,reason:string,confidence:string,conflicts:array<string>,uncertainty_details:array<string>,us_exceptions:array<string>>, wanted string")
    assert rows.filter(screening.enforcement(F.col("a")) != F.col("wanted")).count() == 0
    done = screening.screen(rows.withColumns({"title": F.lit("X"), "description": F.lit("fine")}), assessment="a").collect()
    assert [r["screening"]["outcome"] for r in done] == ["exclude" if c[6] == "exclude" else "keep" for c in cases] and done[0]["screening"]["reasons"] == ["geo_h:exclude:explicit_foreign_employee_location"]


def test_report(spark):
    rows = spark.createDataFrame([("A", "s", "keep", 1), ("A", "t", "exclude", 2), ("B", "s", "exclude", 3), ("B", "s", "defer", 4), ("C", "t", "keep", 5)], "logical_job_id string, source string, outcome string, n int")
    assert {tuple(r) for r in report.outcome_counters(rows, ["source"]).collect()} == {("s", 2, 0, 1, 1), ("t", 2, 1, 0, 1)}
    masks = {"a": F.col("n") > 2, "b": F.col("outcome") == "exclude"}
    assert tuple(report.funnel(rows, F.col("logical_job_id"), masks).first()) == (3, 2, 0, 1)
    assert tuple(report.standalone(rows, F.col("logical_job_id"), masks).first()) == (2, 0) and report.overlaps(rows, masks).first()["a_and_b"] == 1
    assert [r[0] for r in report.changed_without(rows, "s").collect()] == ["A"] and report.shared_groups(rows, "logical_job_id").count() == 1
    assert report.combined(rows, rows.drop("n")).count() == 10 and report.sample(rows, 3, 7, "n").collect() == report.sample(rows.repartition(3), 3, 7, "n").collect()
    assert report.sample(rows, 99, 7, "n").count() == 5
    assert rows.limit(1).select(report.percent(F.lit(1), F.lit(0)), report.reason_label(F.lit("title"), F.lit("k"), F.lit("x")), report.shown_time(F.lit(None).cast("timestamp"))).first()[:] == (0.0, "title/k ('x')", "Unknown")


def test_report_files(spark, tmp_path):
    rows = spark.createDataFrame([(f"L{k}", k) for k in range(50)], "logical_job_id string, n int")
    report.write_report({"total": rows.agg(F.count("n").alias("n"))}, f"file://{tmp_path}/r", samples={"kept": rows}, size=3)
    assert spark.read.json(f"{tmp_path}/r/total").first()["n"] == 50 and spark.read.json(f"{tmp_path}/r/sample_kept").count() == 3
    dates = spark.sql("SELECT TIMESTAMP '2024-01-02 23:59:59Z' AS t UNION ALL SELECT NULL").select(report.shown_date(F.col("t")).alias("d")).collect()
    assert sorted(r["d"] for r in dates) == ["2024-01-02", "Unknown"]
    entries = rows.withColumnRenamed("n", "position")
    assert [r["position"] for r in report.first_of(entries, 2).collect()] == [0, 1] and report.first_of(entries, 0).count() == 0
    with pytest.raises(ValueError):
        report.first_of(entries, -1)


class Board(BaseHTTPRequestHandler):
    failures: dict = {}

    def do_GET(self):
        path, _, query = self.path.partition("?")
        scope, asked = path.strip("/").split("/")[0], dict(x.split("=") for x in query.split("&"))
        left = Board.failures.get(scope, 0)
        Board.failures[scope] = left - 1
        status, body = 200, None
        if left > 0:
            status = 503
        elif path.endswith("/jobs"):
            body = {"jobs": [{"id": 1}, {"id": 2}], "meta": {"total": 3 if scope == "short" else 2}}
        elif scope == "gone":
            status = 404
        else:
            every = [{"id": f"{k}"} for k in range({"full": 4, "some": 3, "none": 0}.get(scope, 1))] + [{"id": "0"}] * (scope == "twice")
            body = every[int(asked["skip"]) : int(asked["skip"]) + int(asked["limit"])]
        self.send_response(status)
        self.end_headers()
        self.wfile.write(json.dumps(body).encode())

    def log_message(self, *_):
        pass


@pytest.fixture(scope="module")
def board():
    server = HTTPServer(("127.0.0.1", 0), Board)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


def test_http_source(spark, board):
    Board.failures = {"some": 2, "down": 9}
    spark.dataSource.register(http.PostingsSource)
    read = lambda provider, scopes: spark.read.format("postings").options(provider=provider, base_url=board, scopes=json.dumps(scopes), page_size="2", backoff="0.01").load().collect()
    got = {}
    for r in read("lever", ["full", "some", "none", "gone", "twice", "down"]):
        got.setdefault(r["source_scope"], []).append((r["payload_json"], r["error"]))
    assert [json.loads(p)["id"] for p, _ in got["full"]] == ["0", "1", "2", "3"] and len(got["some"]) == 3 and got["none"] == [(None, None)]
    assert [got[s][0][1] for s in ("gone", "twice", "down")] == ["HTTP status 404", "posting 1 repeats an id", "HTTP status 503; 3 attempts"]
    rows = {r["source_scope"]: r["error"] for r in read("greenhouse", ["ok", "short"])}
    assert rows == {"ok": None, "short": "meta.total differs from the jobs"}


def test_http_rules():
    assert http.wait_asked("7") == 7 and http.wait_asked("9" * 20) == float("inf") and http.wait_asked("soon") is None and http.wait_asked(None) is None
    assert http.wait_asked("Wed, 21 Oct 2015 07:28:00 GMT") == 0
    import ssl

    assert http.passing(http.URLError("Timed out ")) and http.passing(ConnectionResetError()) and not http.passing(http.URLError(ssl.SSLError())) and not http.passing(OSError(13, "x"))
    for bad in ({"base_url": "http://example.org"}, {"attempts": 4}, {"timeout": float("inf")}, {"provider": "x"}):
        with pytest.raises(ValueError):
            http.Settings(**({"provider": "lever", "base_url": "https://h"} | bad))


def test_registry(spark, tmp_path):
    (tmp_path / "r.json").write_text(json.dumps([{"site": " a ", "company": "A"}, {"site": "a", "company": "B"}, {"site": "", "company": "C"}, 5, {"site": "b"}, {"site": "b", "company": "B"}]))
    good, issues = registry.registry(spark, str(tmp_path / "r.json"))
    assert sorted(tuple(r) for r in good.collect()) == [(0, "a", "A"), (5, "b", "B")]
    assert sorted(tuple(r) for r in issues.collect()) == [(1, "a", "repeated site"), (2, None, "no site"), (3, None, "not an object"), (4, "b", "no company")]
