"""Screening of postings: test postings and occupations exclude, missing descriptions defer; geography may only exclude."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.functions.text import casefold, collapse, let
from ledgerline.operators.occupation import matches

# A test posting's disclaimer, placeholders for a description, and exclusions that geography may enforce.
DEMO = r"(?iU)(?d)(?:these jobs are testing jobs of lever.s testing environment|this (?:job|posting) is (?:a |an )?(?:test|demo) (?:job|posting)|this (?:job|posting) is (?:part of |in )?(?:a |the )?testing environment|this is (?:a |an )(?:test|demo) (?:job|posting)).{0,200}?(?:do not|don't) apply"
PLACEHOLDERS = ("", "n/a", "tbd", "[insert general job description here]")
ENFORCED = ("US_employment_prohibited", "explicit_foreign_employee_location", "structured_foreign_work_location", "structured_foreign_remote_boundary", "corroborated_foreign_city")


def demo(description: Column) -> Column:
    """The disclaimer that asks not to apply, or null."""
    match = F.regexp_extract(description, DEMO, 0)
    return F.when(match != "", match)


def missing(description: Column) -> Column:
    return casefold(description).isin(*PLACEHOLDERS)


def enforcement(assessment: Column) -> Column:
    """What an assessment of geography (outcome, reason, confidence, conflicts, uncertainty_details, us_exceptions) may do: exclude, pass or review_only."""
    unsure = (F.size(assessment["conflicts"]) > 0) | (F.size(assessment["uncertainty_details"]) > 0)
    safe = (assessment["outcome"] == "exclude") & (assessment["confidence"] == "high") & assessment["reason"].isin(*ENFORCED) & (F.size(assessment["us_exceptions"]) == 0)
    return F.when(unsure, "review_only").when(assessment["outcome"] == "keep", "pass").when(safe, "exclude").otherwise("review_only")


def enforced(outcome: Column, action: Column) -> Column:
    """The outcome, made to exclude where geography safely does; passing never undoes an exclusion."""
    return F.when(action == "exclude", F.lit("exclude")).otherwise(outcome)


def item(field: str, value: Column) -> Column:
    return F.struct(F.lit(field).alias("field"), value.alias("value"))


def summary(assessment: Column, action: Column) -> Column:
    """Where a posting can be worked on, from the action: never a second judgement."""
    home = F.when(assessment["work_mode"] == "remote", "us_remote").otherwise("us")
    return F.when(action == "exclude", "foreign_only").when(action == "pass", home).otherwise("uncertain")


def _geographic_proof(found: Column, action: Column) -> list[Column]:
    """Arrays of evidence: the decision, its proofs, and the names in it."""
    head = F.array(item("geo_h.action", action), *(item(f"geo_h.{k}", found[n]) for k, n in (("assessment", "outcome"), ("reason", "reason"), ("confidence", "confidence"), ("work_mode", "work_mode"))))
    proofs = [_prefixed(found[n], p) for n, p in (("evidence", "geo_h."), ("us_exceptions", "geo_h.us_exception."), ("foreign_restrictions", "geo_h.foreign_restriction."))]
    names = (("countries", "country"), ("regions", "region"), ("conflicts", "conflict"), ("uncertainty_details", "uncertainty"))
    return [head, *proofs, *(_items(found[n], f"geo_h.{k}") for n, k in names)]


def _prefixed(proofs: Column, prefix: str) -> Column:
    return F.transform(proofs, lambda e: F.struct(F.concat(F.lit(prefix), e["field"]).alias("field"), e["value"].alias("value")))


def _items(values: Column, field: str) -> Column:
    return F.transform(values, lambda v: item(field, v))


def screen(rows: DataFrame, *, title: str = "title", description: str = "description", assessment: str | None = None, whole: bool = False) -> DataFrame:
    """The rows with screening (outcome, reasons, evidence), reasons in order: test posting, description, occupations, geography.

    One expression, so that a filter on the outcome screens once. With `whole`, the assessment's proofs are
    evidence as well, and `geography` sums it up.
    """

    def judged(x: Column) -> Column:
        found, absent, jobs = x["demo"].isNotNull(), x["missing"], x["jobs"]
        outcome = F.when(found | (F.size(jobs) > 0), "exclude").when(absent, "defer").otherwise("keep")
        reasons = [F.array_compact(F.array(F.when(found, F.lit("explicit_testing_do_not_apply")), F.when(absent, F.lit("insufficient_description")))), F.transform(jobs, lambda j: j["reason"])]
        proof = [
            F.array_compact(F.array(F.when(found, item("description", x["demo"])), F.when(absent, item("description", x["text"])))),
            F.flatten(F.transform(jobs, lambda j: F.concat(F.array(item("title", j["title"])), F.transform(j["duties"], lambda d: item("description", d))))),
        ]
        if assessment:
            found = F.col(assessment)
            action = enforcement(found)
            outcome = enforced(outcome, action)
            reasons.append(F.array(F.concat(F.lit("geo_h:"), action, F.lit(":"), found["reason"])))
            proof += _geographic_proof(found, action) if whole else []
        made = [outcome.alias("outcome"), F.concat(*reasons).alias("reasons"), F.concat(*proof).alias("evidence")]
        return F.struct(*made, *([summary(found, action).alias("geography")] if assessment and whole else []))

    text = collapse(F.coalesce(F.col(description), F.lit("")))
    seen = let(text, lambda t: F.struct(t.alias("text"), demo(t).alias("demo"), missing(t).alias("missing"), matches(F.col(title), F.col(description)).alias("jobs")))
    return rows.withColumn("screening", let(seen, judged))
