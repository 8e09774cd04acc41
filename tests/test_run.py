import json
import random
import threading
from datetime import UTC, datetime, timedelta
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest

from ledgerline import __main__ as cli
from ledgerline import run
from ledgerline.operators import lifecycle, policy, store
from ledgerline.streaming import snapshots

DAY = datetime(2024, 1, 1, tzinfo=UTC)
READ = "source string, source_scope string, retrieved_at timestamp, position long, payload_json string, error string"
RULES = policy.Policy(title_exclude=("director",))


def lever(i, title="Clerk", **more):
    return json.dumps({"id": str(i), "text": title, "hostedUrl": f"https://h/{i}", "applyUrl": f"https://h/a{i % 3}", "descriptionPlain": "d"} | more)


def test_run(spark, tmp_path):
    kept = store.Store(spark, f"file://{tmp_path}/s").create()
    read = lambda *rows: spark.createDataFrame([(p, s, DAY + timedelta(days=d), 0, x, e) for p, s, d, x, e in rows], READ)
    rows = [("lever", "x", 1, lever(k), None) for k in range(5)] + [("lever", "x", 1, lever(5, "Director"), None), ("lever", "bad", 1, None, "HTTP status 404"), ("lever", "odd", 1, lever(7, hostedUrl="no"), None), ("lever", "none", 1, None, None)]
    boards = [("greenhouse", "g", 1, json.dumps({"id": 3, "title": "Clerk", "absolute_url": "https://h/g3", "content": "x"}), None)]
    names = {"x": "Acme", "bad": "Bad", "odd": "Odd", "none": "None"}
    done = run.run(kept, {"lever": (read(*rows), names), "greenhouse": (read(*boards), {"g": "Acme"})}, RULES, f"file://{tmp_path}/decisions")
    assert done.batches["lever"] == run.Batch(4, 2, 6, (("bad", "HTTP status 404"), ("odd", "violations: job_url"))) and done.batches["greenhouse"] == run.Batch(1, 1, 1, ())
    # Three application URLs among six postings: three entities, and one from the other provider.
    assert done.acquired == 7 and done.catalog == run.Processed(resolved=7, created=4, evaluated=7, rejected=1, eligible=4)
    assert spark.read.parquet(f"{tmp_path}/decisions").filter("rejected").count() == 1
    assert {r["source_scope"] for r in kept.table("scope_state").collect()} == {"x", "none", "g"}
    again = run.run(kept, {"lever": (read(*rows[:6]), {"x": "Acme"})}, RULES)
    assert again.batches["lever"].failures == (("x", "snapshot is not newer"),) and again.catalog == run.Processed(0, 0, 7, 1, 4)
    later = run.run(kept, {"lever": (read(("lever", "x", 2, lever(0), None), ("lever", "x", 2, lever(8, applyUrl=None), None)), {"x": "Acme"})}, RULES)
    assert later.acquired == 2 and later.catalog == run.Processed(resolved=1, created=1, evaluated=3, rejected=0, eligible=3)


class Site(BaseHTTPRequestHandler):
    def do_GET(self):
        self.send_response(404 if "gone" in self.path else 200)
        self.end_headers()
        self.wfile.write(b"[" + ",".join(lever(k) for k in range(2)).encode() + b"]")

    def log_message(self, *_):
        pass


def test_command_line(spark, tmp_path, capsys):
    server = HTTPServer(("127.0.0.1", 0), Site)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = ["--company", "Acme", "--store", f"file://{tmp_path}/s", "--api-base-url", f"http://127.0.0.1:{server.server_port}"]
    rules = tmp_path / "p.toml"
    rules.write_text('version = 1\n[title]\ninclude_any = []\nexclude_any = []\n[location]\ninclude_any = []\nexclude_any = []\n[company]\nexclude = []\n[description]\ninclude_any = []\nexclude_any = []\n')
    assert cli.main(["acquire-lever", "--site", "s", *base]) == 0 and "2 postings of 's'" in capsys.readouterr().out
    assert cli.main(["run-lever-pipeline", "--site", "t", *base, "--filter-policy", str(rules)]) == 0 and "Acquired 2 postings; resolved 4; evaluated 4 active postings; 2 entities" in capsys.readouterr().out
    assert cli.main(["acquire-lever", "--site", "gone", *base]) == 1 and "HTTP status 404" in capsys.readouterr().err
    assert cli.main(["run-lever-pipeline", "--site", "t", *base, "--filter-policy", str(tmp_path / "none")]) == 1 and "cannot read" in capsys.readouterr().err
    for bad in (["--site", " "], ["--site", "s", "--page-size", "0"], ["--site", "s", "--timeout-seconds", "x"], ["--site", "s", "--api-base-url", "https://h?q"], []):
        with pytest.raises(SystemExit):
            cli.main(["acquire-lever", *base, *bad])
    server.shutdown()


@pytest.mark.parametrize("cuts", [1, 3, 9])
def test_stream_of_snapshots_is_the_replay(spark, tmp_path, cuts):
    """Whatever the micro-batches; late snapshots of a scope are left out, and empty ones end its postings."""
    rng = random.Random(4)
    log = [(c, str(i), DAY + timedelta(days=d)) for d in range(9) for c in "xy" if rng.random() < 0.8 for i in range(6) if rng.random() < 0.5]
    days = sorted({at for _, _, at in log})
    source = tmp_path / "in"
    source.mkdir()
    for n in range(cuts):
        part = [e for e in log if days.index(e[2]) * cuts // len(days) == n]
        late = [("x", "99", DAY)] if n == cuts - 1 and cuts > 1 else []
        end = [("x", None, DAY + timedelta(days=20))] if n == cuts - 1 else []
        spark.createDataFrame(part + late + end, "scope string, id string, at timestamp").coalesce(1).write.mode("append").parquet(f"file://{source}/b{n}")
        stream = spark.readStream.schema("scope string, id string, at timestamp").option("recursiveFileLookup", "true").parquet(f"file://{source}")
        snapshots.follow(stream, f"file://{tmp_path}/state", f"file://{tmp_path}/checkpoint").awaitTermination()
    got = {tuple(r) for r in snapshots.state(spark, f"file://{tmp_path}/state").collect()}
    wanted = set()
    for r in lifecycle.replay(spark.createDataFrame(log, "scope string, id string, at timestamp")).collect():
        ended = r["scope"] == "x" and r["status"] == "active"
        wanted.add((r["scope"], r["id"], "inactive" if ended else r["status"], r["first_seen"], r["last_seen"], (DAY + timedelta(days=20)).replace(tzinfo=None) if ended else r["inactive_at"]))
    assert got == wanted
