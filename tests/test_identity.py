import random

import pytest
from pyspark.sql import functions as F

from ledgerline.operators import identity
from ledgerline.operators.components import components

SCHEMA = "source string, scope string, id string, company string, job_url string, apply_url string, logical_id string, title string, location string, description string"


def resolved_by_hand(rows):
    """One row after the other, in the order of keys; valid canonical URLs and companies only."""
    known, out = {}, {}

    def ends(r):
        return [(r[3], kind, u) for kind, u in (("j", r[4]), ("a", r[5])) if u]

    for r in rows:
        if r[6]:
            for e in ends(r):
                known.setdefault(e, set()).add(r[6])
    for r in sorted(r for r in rows if not r[6]):
        found = set().union(*(known.get(e, set()) for e in ends(r)))
        matched = len(found) == 1
        logical = found.pop() if matched else identity.new_id(*r[:3])
        out[r[:3]] = (logical, matched)
        for e in ends(r):
            known.setdefault(e, set()).add(logical)
    return out


def posting(rng, k, urls, linked, companies=3):
    pick = lambda: rng.choice([None, *(f"https://h/{n}" for n in range(urls))])
    return (rng.choice("ab"), rng.choice("xy"), f"{k:05d}", f"c{rng.randrange(companies)}", pick(), pick(), f"L{rng.randrange(4)}" if rng.random() < linked else None, "t", None, rng.choice("pq"))


@pytest.mark.parametrize("urls,linked,n", [(3, 0.0, 60), (12, 0.1, 150), (40, 0.2, 150), (300, 0.05, 300)])
def test_resolve_is_the_pass_in_order(spark, urls, linked, n):
    rng = random.Random(urls)
    rows = [posting(rng, k, urls, linked) for k in range(n)]
    got = {tuple(r[k] for k in identity.KEYS): (r["logical_id"], r["matched"]) for r in identity.resolve(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect()}
    assert got == resolved_by_hand(rows)


def test_a_url_of_most_rows_is_one_row_of_the_pass(spark):
    """All share an application URL; a few tie it to shared job URLs, and one of these makes it name several."""
    rows = [("s", "x", f"{k:05d}", "c", f"https://h/{k}", "https://h/apply", None, "t", None, "d") for k in range(3000)]
    rows += [("s", "x", "00100b", "c", "https://h/90", "https://h/apply", None, "t", None, "d"), ("s", "x", "02000b", "c", "https://h/old", "https://h/apply", None, "t", None, "d"), ("s", "x", "a", "c", "https://h/old", None, "L", "t", None, "d")]
    made = spark.createDataFrame(rows, SCHEMA).cache()
    got = {tuple(r[k] for k in identity.KEYS): (r["logical_id"], r["matched"]) for r in identity.resolve(made).collect()}
    assert got == resolved_by_hand(rows) and sum(m for _, m in got.values()) == 2001
    assert len(set(i for i, _ in got.values())) == 1001


def test_odd_rows(spark):
    rows = [("s", "x", "1", None, None, None, None, None, None, None), ("s", "x", "2", " ", "ftp://h/1", None, None, None, None, None), ("s", "x", "3", "ACME  inc", "HTTPS://H:443/1#x", None, None, None, None, None), ("s", "x", "4", "acme inc", "https://h/1", None, None, None, None, None), ("s", "x", "5", "acme inc", None, "https://h/1", None, None, None, None)]
    made = spark.createDataFrame(rows, SCHEMA)
    got = {r["id"]: (r["logical_id"], r["matched"]) for r in identity.resolve(made).collect()}
    assert got == {k: (identity.new_id("s", "x", "3" if k == "4" else k), k == "4") for k in "12345"}
    assert identity.resolve(made.filter("false")).count() == 0


def test_evidence(spark):
    rows = [
        ("s", "x", "1", "c", "https://h/1", "https://h/a", "L1", "t", None, "d"),
        ("s", "x", "9", "c", "https://h/9", None, "L9", "T ", None, " D"),
        ("s", "x", "2", "c", "https://h/1", "https://h/a", None, "t", None, "other"),
        ("s", "x", "3", "c", "https://h/9", "https://h/a", None, "t", "", "d"),
        ("s", "x", "4", "c", "https://h/4", None, None, "t", None, "d"),
        ("s", "x", "5", "other", "https://h/1", None, None, "t", None, "d"),
    ]
    made = spark.createDataFrame(rows, SCHEMA)
    done = identity.resolve(made)
    got = {r["id"]: (r["created"], [tuple(e) for e in r["evidence"]]) for r in identity.evidence(made, done).collect()}
    three, by_content = identity.new_id("s", "x", "3"), made.filter("id = '4'").select(identity.content_print(made)).first()[0]
    job, apply, content, auto, candidate = "exact_canonical_job_url", "exact_canonical_apply_url", "exact_content_fingerprint", "automatic_link", "duplicate_candidate"
    assert got["2"] == (False, [(job, "s", "x", "1", "L1", auto, "https://h/1"), (apply, "s", "x", "1", "L1", auto, "https://h/a")])
    assert got["3"] == (True, [(apply, "s", "x", "1", "L1", candidate, "https://h/a"), (apply, "s", "x", "2", "L1", candidate, "https://h/a"), (job, "s", "x", "9", "L9", candidate, "https://h/9")])
    assert got["4"] == (True, [(content, "s", "x", "1", "L1", candidate, by_content), (content, "s", "x", "9", "L9", candidate, by_content)])
    assert got["5"] == (True, []) and three in {r["logical_id"] for r in done.collect()}
    assert [r["id"] for r in identity.evidence(made, done, made.filter("id = '4'")).collect()] == ["4"]
    groups = {(r["kind"], r["value"]): (r["postings"], r["entities"], r["first"]["id"]) for r in identity.evidence_groups(made, done).collect()}
    assert groups == {(job, "https://h/1"): (2, 1, "1"), (job, "https://h/9"): (2, 2, "3"), (apply, "https://h/a"): (3, 2, "1"), (content, by_content): (3, 3, "1")}


@pytest.mark.parametrize("n,edges", [(30, 20), (200, 190), (300, 100)])
def test_components(spark, n, edges):
    rng = random.Random(n)
    pairs = [(rng.randrange(n), rng.randrange(n)) for _ in range(edges)] + [(k, k + 1) for k in range(1000, 1040)] + [(5000, k) for k in range(5001, 5100)] + [(7, 7)]
    least = {x: x for p in pairs for x in p}
    for _ in range(len(least)):
        changed = False
        for a, b in pairs:
            low = min(least[a], least[b])
            changed |= least[a] != low or least[b] != low
            least[a] = least[b] = low
        if not changed:
            break
    assert {tuple(r) for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()} == set(least.items())
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
