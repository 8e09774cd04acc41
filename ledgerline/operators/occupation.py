"""Occupational categories of postings, each with its evidence: a title and a clause that names the duty."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.functions.text import collapse, let

#: The categories' names, in the order of reasons.
REASONS = ("paid_survey_participation", "retail_store_operations", "licensed_clinical_care", "food_service_operations")

# Patterns, matched without regard to case.
TECHNICAL_TITLE = r"\b(?:software|engineer(?:ing)?|developer|programmer|devops|informatics|bioinformatics|data (?:analyst|analytics|scientist|engineer)|technical support|help[ -]?desk|service desk|systems?|cloud|cybersecurity|automation|robotics|firmware|embedded|QA|quality assurance|survey (?:methodologist|statistician))\b|\bIT\b"
TECHNICAL_DUTY = r"^(?:(?:you(?: will|'ll)?|responsibilities include|duties include)\s+)?(?:design|build|develop|debug|implement|maintain|write|deploy|configure)\b[^.!?]{0,70}\b(?:software|APIs?|microservices|source code|Python|JavaScript|SQL (?:queries|pipelines)|data pipelines|cloud infrastructure|network infrastructure|automated tests|POS integrations)\b|^(?:you(?: will|'ll)?\s+)?(?:provide technical support for [^.!?]{0,50}(?:software|applications|survey platforms?|POS systems?|networks)|troubleshoot [^.!?]{0,40}(?:software|network infrastructure|APIs)|(?:analyze|model|query|visualize) [^.!?]{0,60}(?:SQL|Python|statistical models))\b"
POLL_TITLE = r"\b(?:data entry|customer (?:service|care)|client service|panelist|survey (?:taker|participant|respondent)|questionnaire|focus group|reviewer)\b"
POLL_DUTY = r"\b(?:earn (?:at home )?by taking (?:paid )?(?:polls|surveys)|participate in (?:paid |online )?(?:polls|surveys|focus groups)|(?:complete|take|answer|fill out) (?:paid |online |consumer )*(?:surveys|polls|questionnaires))\b"
POLL_PAYMENT = r"\b(?:earn (?:at home )?by taking (?:paid )?(?:polls|surveys)|paid (?:polls|surveys|questionnaires|focus groups)|earn extra income|earn money|compensated (?:for|to))\b"
APPLICATION_STEP = r"\b(?:to apply|application (?:process|questionnaire)|during onboarding|as part of (?:the )?(?:application|hiring))\b"
RETAIL_TITLE = r"\b(?:key[ -]?holder|cashier|merchandiser|merchandising (?:associate|specialist)|retail (?:associate|sales|shift|store)|store (?:associate|manager|floor lead)|assistant (?:store )?manager|shift (?:lead|leader|manager)|sales floor)\b"
RETAIL_DUTY = r"\b(?:work (?:the|a) (?:cash )?register|process (?:retail |sales )?transactions|(?:open|close|opening|closing) (?:and (?:close|open) )?(?:the |our )?store|(?:cover|manage|lead|support|supervise|work|maintain|replenish|stock) (?:the |our )?sales floor|(?:stock|restock|replenish|display|arrange) (?:store |retail )?(?:shelves|merchandise|displays)|(?:assist|help|serve) (?:in-store )?(?:customers|shoppers) [^.!?]{0,45}(?:purchases|shopping|merchandise)|(?:perform|process|handle) retail transactions)\b"
RETAIL_MANAGEMENT_DUTY = r"\b(?:support (?:your |the |our )?store manager [^.!?]{0,65}(?:sales plan|sales targets)|merchandise (?:the|our) store|manage (?:day-to-day )?store operations|run (?:your|the|our) store)\b"
CLINICAL_TITLE = r"\b(?:physician|hospitalist|geriatrician|surgeon|psychiatrist|psychologist|nurse|clinical practitioner|nurse practitioner|physician assistant|dentist|physical therapist|occupational therapist|respiratory therapist|mammography technologist|x-ray technologist|board certified behavior analyst|BCBA)\b"
CLINICAL_DUTY = r"\b(?:(?:provid(?:e|es|ing)|deliver(?:s|ing)?|perform(?:s|ing)?|administer(?:s|ing)?|conduct(?:s|ing)?|coordinat(?:e|es|ing)|manag(?:e|es|ing)) [^.!?]{0,65}(?:patient care|clinical care|bedside|wound care|psychotherapy|psychiatric (?:care|evaluations)|psychological (?:testing|assessments)|clinical (?:assessments|evaluations)|treatment plans|nursing care|behavior(?:al)? (?:therapy|treatment)|mammogra\w*|x-ray examinations)|(?:diagnose|treat|assess|evaluate|examine) (?:and (?:treat|diagnose|assess) )?(?:patients|clients)|prescribe (?:medication|medications)|(?:care|caring) for (?:adult|child|adolescent|patients)|complete(?:s|ing)? medication reconciliation)\b"
FOOD_TITLE = r"\b(?:cookie crew|shift (?:leader|lead|manager)|chef|cook|kitchen (?:assistant|staff|crew)|culinary lead|bakery (?:staff|associate|crew)|food service (?:worker|staff)|restaurant (?:crew|staff|server)|barista|dishwasher)\b"
FOOD_DUTY = r"\b(?:(?:bake|prepare|cook|serve|package|deliver) [^.!?]{0,45}(?:cookies|food|meals|dough|pastries|beverages|coffee)|(?:lead|manage|supervise|oversee) [^.!?]{0,45}(?:bakery|kitchen|restaurant) (?:operations|staff|team)|(?:teach|instruct|lead|assist) [^.!?]{0,45}(?:cooking|culinary) (?:classes|instruction)|(?:clean|sanitize|wash) [^.!?]{0,35}(?:dishes|kitchen equipment|food preparation)|follow(?:s|ing)? provided recipes)\b"
NEGATION = r"\b(?:not|never|no)\b"

_ANY_CASE = "(?iU)"


def found_in(text: Column, pattern: str) -> Column:
    """The first match, or null."""
    match = F.regexp_extract(text, _ANY_CASE + pattern, 0)
    return F.when(match != "", match)


def clauses(text: Column) -> Column:
    """Clauses between full stops, marks and line ends, without bullets, with single spaces."""
    return F.transform(F.split(text, r"[\n.!?]+"), lambda c: collapse(F.regexp_replace(c, r"^[ \-•\t]+|[ \-•\t]+$", "")))


def duty(parts: Column, pattern: str) -> Column:
    """The first clause that names the duty without a negation before it, or null."""
    named = F.filter(parts, lambda c: c.rlike(_ANY_CASE + pattern) & ~F.get(F.split(c, _ANY_CASE + pattern, 2), F.lit(0)).rlike(_ANY_CASE + NEGATION))
    return F.get(named, F.lit(0))


def matches(title: Column, description: Column) -> Column:
    """An array of (reason, title, duties); empty for technical titles and duties.

    Titles are tested before clauses are looked at, so that few descriptions are searched.
    """

    def category(reason: str, head: Column, *duties: Column) -> Column:
        whole = head.isNotNull()
        for d in duties:
            whole = whole & d.isNotNull()
        return F.when(whole, F.struct(F.lit(reason).alias("reason"), head.alias("title"), F.array_distinct(F.array(*duties)).alias("duties")))

    def judged(parts: Column) -> Column:
        poll = let(duty(parts, POLL_DUTY), lambda d: F.when(~d.rlike(_ANY_CASE + APPLICATION_STEP), d))
        made = [
            category(REASONS[0], found_in(title, POLL_TITLE), poll, duty(parts, POLL_PAYMENT)),
            category(REASONS[1], found_in(title, RETAIL_TITLE), F.coalesce(duty(parts, RETAIL_DUTY), duty(parts, RETAIL_MANAGEMENT_DUTY))),
            category(REASONS[2], found_in(title, CLINICAL_TITLE), duty(parts, CLINICAL_DUTY)),
            category(REASONS[3], found_in(title, FOOD_TITLE), duty(parts, FOOD_DUTY)),
        ]
        none = F.array().cast("array<struct<reason:string,title:string,duties:array<string>>>")
        return F.when(duty(parts, TECHNICAL_DUTY).isNotNull(), none).otherwise(F.array_compact(F.array(*made)))

    none = F.array().cast("array<struct<reason:string,title:string,duties:array<string>>>")
    candidate = ~title.rlike(_ANY_CASE + TECHNICAL_TITLE) & title.rlike(_ANY_CASE + "|".join((POLL_TITLE, RETAIL_TITLE, CLINICAL_TITLE, FOOD_TITLE)))
    return F.when(F.coalesce(candidate, F.lit(False)), let(clauses(F.coalesce(description, F.lit(""))), judged)).otherwise(none)


def with_occupations(rows: DataFrame, *, title: str = "title", description: str = "description") -> DataFrame:
    return rows.withColumn("occupations", matches(F.col(title), F.col(description)))
