import json

import pytest
from pyspark.sql import functions as F

from ledgerline.operators import gazetteer, geography, screening

PLACES = [  # text, us, countries, regions, countries of cities
    (None, False, [], [], []),
    ("", False, [], [], []),
    ("Hanoi", False, [], [], ["Vietnam"]),
    ("hanoi, VIET NAM", False, ["Vietnam"], [], ["Vietnam"]),
    ("New Mexico", True, [], [], []),
    ("Mexico", False, ["Mexico"], [], []),
    ("Mexico City / Monterrey", False, ["Mexico"], [], ["Mexico"]),
    ("Tijuana, Baja California, Mexico", False, ["Mexico"], [], []),
    ("Lebanon, Tennessee", True, [], [], []),
    ("Lebanon, Tennessee 37087", True, [], [], []),
    ("Peru, IL", True, [], [], []),
    ("IL, Peru", False, ["Peru"], [], []),
    ("Springfield, MO, Greece", False, ["Greece"], [], []),
    ("Cape Town, South Africa", False, ["South Africa"], [], ["South Africa"]),
    ("Africa", False, [], ["Africa"], []),
    ("emea | APAC", False, [], ["APAC", "emea"], []),
    ("Paris", False, [], [], ["France"]),
    ("Paris, TX", True, [], [], []),
    ("Georgia", False, [], [], []),
    ("join us", False, [], [], []),
    ("US", True, [], [], []),
    ("the U.S. or Kenya", True, ["Kenya"], [], []),
    ("Austin; Lagos, Nigeria", True, ["Nigeria"], [], []),
    ("Auburn, NewYork 13021", True, [], [], []),
    ("Northern Ireland", False, ["United Kingdom"], [], []),
    ("Indiana and Niger", True, [], [], []),
    ("Washington\x01DC", True, [], [], []),
    ("Vienna " * 3000, False, [], [], ["Austria"]),
]


def test_places(spark):
    rows = spark.createDataFrame([(k, r[0]) for k, r in enumerate(PLACES)], "k int, t string").select("k", gazetteer.places(F.col("t")).alias("p"))
    got = {r["k"]: (r["p"]["us"], r["p"]["countries"], r["p"]["regions"], r["p"]["cities"]) for r in rows.collect()}
    for k, (text, *wanted) in enumerate(PLACES):
        assert got[k] == tuple(wanted), text


def test_every_name_is_known_by_itself(spark):
    names = {**{c: c for c in gazetteer.COUNTRIES}, **gazetteer.COUNTRY_ALIASES}
    found = spark.createDataFrame(list(names.items()), "n string, c string").filter(~gazetteer.places(F.col("n"))["countries"].eqNullSafe(F.array("c")) | ~gazetteer.starts_with_place(F.concat(F.lit("(only the "), "n")))
    assert sorted(r["n"] for r in found.collect()) == ["Bosnia and Herzegovina", "Trinidad and Tobago"]  # segments end at "and"
    cities = [(x, c) for c, all_of in gazetteer.CITIES.items() for x in all_of.split("|")]
    missed = spark.createDataFrame(cities, "n string, c string").filter(~F.array_contains(gazetteer.places(F.col("n"))["cities"], F.col("c")))
    assert [r["n"] for r in missed.collect()] == []


def test_clauses_windows_and_spans(spark):
    one = lambda column: spark.range(1).select(column.alias("x")).first()["x"]
    text = "- First part. Second one!  third goes on. (Fourth)\r\n• In the U.S. Army\n \n last\x85end"
    assert one(geography.clauses(F.lit(text))) == ["First part.", "Second one! third goes on. (Fourth)", "In the United States Army", "last", "end"]
    assert one(geography.clauses(F.lit(None).cast("string"))) == [] == one(geography.clauses(F.lit(" \n-•\n")))
    assert one(geography.window(F.lit("Kenya with clients in Peru"))) == "Kenya " and one(geography.window(F.lit("Kenya; Peru"))) == "Kenya"
    assert len(one(geography.window(F.lit("x" * 5000)))) == geography.WINDOW
    found = [tuple(s) for s in one(geography.spans(F.lit("a no\x01t b NOT c"), r"\bnot\b"))]
    assert found == [("a ", "not", " b NOT c"), ("a not b ", "NOT", " c")]
    assert one(geography.spans(F.lit("nothing"), "x")) == []
    assert one(F.size(geography.authorisations(F.lit("You must be authorized to work in the US")))) == 1
    assert one(F.size(geography.authorisations(F.lit("If you choose US you must be authorized to work in the US")))) == 0


# location, description, payload of the first source or None, reason
STEPS = [
    ("Germany", "Applicants must live in Japan.", None, "conflicting_location_evidence"),
    ("France", "This role is not open to candidates in the United States.", None, "US_employment_prohibited"),
    ("Remote, not available in the US", "Fine work.", None, "US_employment_prohibited"),
    ("Denver, CO", "Fine work.", None, "US_or_worldwide_work_option"),
    (None, "You may relocate after a year to Boston.", None, "US_or_worldwide_work_option"),
    (None, "Employees can live within commuting distance of Chicago.", None, "US_or_worldwide_work_option"),
    (None, "We welcome applicants from any country, remote.", None, "US_or_worldwide_work_option"),
    (None, "This job pays weekly and is remote across North America.", None, "US_or_worldwide_work_option"),
    (None, "Location: Lima or Miami", None, "US_or_worldwide_work_option"),
    (None, "This position is on-site in Phoenix.", None, "US_or_worldwide_work_option"),
    ("Poland", "This role is remote in Poland. Rates differ by country.", None, "remote_policy_or_role_ambiguity"),
    (None, "Candidates need to be based in Oslo.", None, "explicit_foreign_employee_location"),
    (None, "The position is fully onsite in Prague.", None, "explicit_foreign_employee_location"),
    (None, "We accept applicants from any country within Europe, all remote.", None, "explicit_foreign_employee_location"),
    (None, "A hybrid role combining sales and code.", None, "remote_policy_or_role_ambiguity"),
    (None, "Employees based in Spain will attend a yearly meeting.", None, "remote_policy_or_role_ambiguity"),
    ("Remote, UTC+2", "Fine work.", None, "work_clock_not_residence_boundary"),
    ("Remote - Americas", "Fine work.", None, "unresolved_Americas_work_option"),
    ("Global headquarters", "Fine work.", None, "unreliable_location_semantics"),
    ("Greece", "Write as a freelancer.", None, "possible_country_market_tag"),
    ("Remote within Kenya", "Fine work.", None, "structured_foreign_remote_boundary"),
    ("Remote, APAC", "Fine work.", None, "structured_foreign_remote_boundary"),
    ("Remote, Kenya", "Fine work.", None, "foreign_tag_with_unclear_remote_boundary"),
    ("Remote", "Fine work.", {"country": "ke", "workplaceType": "remote"}, "foreign_tag_with_unclear_remote_boundary"),
    ("Nairobi, Kenya", "Fine work.", None, "structured_foreign_work_location"),
    ("Cork", "Fine work.", {"country": "IE"}, "corroborated_foreign_city"),
    ("Cork", "Fine work.", {"country": "PL"}, "insufficient_location_confidence"),
    ("Cork", "Fine work.", None, "insufficient_location_confidence"),
    (None, "Fine work.", {"country": "IE"}, "insufficient_location_confidence"),
    ("Here", None, None, "unknown_work_eligibility"),
    (None, "", None, "unknown_work_eligibility"),
    (None, "Salary for candidates based in Spain.", None, "unknown_work_eligibility"),
    ("Cork", "Fine work.", {"country": "US"}, "conflicting_location_evidence"),
    ("Egypt", "You must be authorized to work in the US.", None, "conflicting_location_evidence"),
    ("Egypt", "You must reside in Egypt. You must be authorized to work in the US.", None, "explicit_foreign_employee_location"),
    ("Chile", "Fine work.", {"categories": {"allLocations": ["Reno, NV", 7, " "]}}, "US_or_worldwide_work_option"),
]
OUTCOME = {"US_employment_prohibited": "exclude", "explicit_foreign_employee_location": "exclude", "structured_foreign_remote_boundary": "exclude", "structured_foreign_work_location": "exclude", "corroborated_foreign_city": "exclude", "US_or_worldwide_work_option": "keep"}


@pytest.fixture(scope="module")
def assessed(spark):
    rows = [(k, "lever" if p else "greenhouse", "Clerk", at, text, json.dumps(p) if p else None) for k, (at, text, p, _) in enumerate(STEPS)]
    rows += [(900, "lever", "Clerk (Lagos)", None, None, "[1"), (901, "lever", "Clerk - Ohio", "Kenya", "Fine work.", '{"country": 7, "categories": []}'), (902, "greenhouse", None, None, None, '{"country": "KE"}'), (902, "greenhouse", None, None, None, '{"country": "KE"}')]
    return {r["k"]: r["geography"] for r in geography.assess(spark.createDataFrame(rows, "k int, source string, title string, location string, description string, payload_json string")).collect()}


def test_first_condition_decides(assessed):
    for k, (at, text, _, reason) in enumerate(STEPS):
        got = assessed[k]
        assert (got["reason"], got["outcome"]) == (reason, OUTCOME.get(reason, "defer")), (at, text, got)
        assert (got["outcome"] == "defer") == bool(got["uncertainty_details"]) and (got["outcome"] == "keep") <= bool(got["us_exceptions"])
    assert {r for *_, r in STEPS} == set(REASONS)


REASONS = ("conflicting_location_evidence", "US_employment_prohibited", "US_or_worldwide_work_option", "remote_policy_or_role_ambiguity", "explicit_foreign_employee_location", "work_clock_not_residence_boundary", "unresolved_Americas_work_option", "unreliable_location_semantics", "possible_country_market_tag", "structured_foreign_remote_boundary", "foreign_tag_with_unclear_remote_boundary", "structured_foreign_work_location", "corroborated_foreign_city", "insufficient_location_confidence", "unknown_work_eligibility")


def test_records(assessed):
    at = {(place, text): assessed[k] for k, (place, text, _, _) in enumerate(STEPS)}
    clash = at["Germany", "Applicants must live in Japan."]
    assert clash["conflicts"] == ["structured_vs_employee_country"] and clash["countries"] == ["Germany", "Japan"] and clash["uncertainty_details"] == ["conflicting_location_evidence", "structured_vs_employee_country"]
    assert [tuple(e) for e in clash["foreign_restrictions"]] == [("description", "Applicants must live in Japan.")]
    assert at["Egypt", "You must be authorized to work in the US."]["conflicts"] == ["US_work_authorization_vs_foreign_work_location"]
    assert [tuple(e) for e in at["Remote, not available in the US", "Fine work."]["foreign_restrictions"]] == [("location", "Remote, not available in the US")]
    assert at["Remote, APAC", "Fine work."]["regions"] == ["APAC"] and at["Remote, APAC", "Fine work."]["work_mode"] == "remote"
    assert assessed[900]["reason"] == "unknown_work_eligibility" and assessed[900]["evidence"] == []
    assert assessed[901]["conflicts"] == ["US_title_vs_foreign_location"] and assessed[902]["reason"] == "unknown_work_eligibility"


def test_screening_enforces_safe_exclusions_only(spark):
    rows = [(k, "greenhouse", "Clerk", at, text, None) for k, (at, text, p, _) in enumerate(STEPS) if p is None]
    made = geography.assess(spark.createDataFrame(rows, "k int, source string, title string, location string, description string, payload_json string"))
    for r in screening.screen(made, assessment="geography").collect():
        if OUTCOME.get(STEPS[r["k"]][3]) == "exclude":
            assert r["screening"]["outcome"] == "exclude" and r["screening"]["reasons"][-1] == f"geo_h:exclude:{STEPS[r['k']][3]}"
        else:
            assert r["screening"]["outcome"] == ("keep" if STEPS[r["k"]][1] else "defer")
    assert screening.screen(geography.assess(made.drop("geography").filter("false")), assessment="geography").count() == 0
