"""The catalog of postings as tables, and its search from criteria to a page.

Tables, keyed by (source, source_scope, source_job_id): `normalized` (company, title, description, location,
job_url, apply_url, posted_at, employment_type, workplace_type, retrieved_at), `raw` (retrieved_at,
payload_json), `lifecycle` (status, first_seen_at, last_seen_at, inactive_at) and `links` (logical_job_id,
linked_at).

A search keeps the logical entities of which one posting holds all criteria. The outcome of an entity
comes from all its active postings, whatever the criteria; the filter on the outcome follows.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.functions.text import ascii_fold, contains_term
from ledgerline.operators.outcomes import OUTCOMES, active_priority, outcome_of
from ledgerline.operators.search import PAGE_SIZES, SearchError, keyword_match, parse_keywords

KEYS = ["source", "source_scope", "source_job_id"]
#: Fields that a keyword may be looked for in, and the sources.
FIELDS = {"title": ("title",), "title_description": ("title", "description"), "all": ("title", "description", "company", "location")}
SOURCES = ("lever", "greenhouse")


def folded(name: str) -> Column:
    return ascii_fold(F.col(name))


#: Sorts; every one ends in the logical id.
SORTS: dict[str, Callable[[], list[Column]]] = {
    "first_seen": lambda: [F.desc("first_seen")],
    "last_seen": lambda: [F.desc("last_seen")],
    "posted_newest": lambda: [F.desc_nulls_last("posted_at")],
    "posted_oldest": lambda: [F.asc_nulls_last("posted_at")],
    "company": lambda: [folded("company"), folded("title")],
    "title": lambda: [folded("title"), folded("company")],
}


@dataclass(frozen=True)
class CatalogCriteria:
    keywords: str = ""
    mode: str = "AND"
    fields: str = "title_description"
    source: str = "all"
    outcome: str = "keep"
    company: str = ""
    location: str = ""
    include_inactive: bool = False
    discovered_since: str = ""
    sort: str = "first_seen"
    employment_type: str = ""
    workplace_type: str = ""

    def check(self) -> None:
        for name, known in (("fields", FIELDS), ("sort", SORTS), ("source", ("all", *SOURCES)), ("outcome", ("all", *OUTCOMES))):
            if getattr(self, name) not in known:
                raise SearchError(f"unknown {name}: {getattr(self, name)!r}")
        parse_keywords(self.keywords, self.mode)
        if self.discovered_since:
            try:
                datetime.fromisoformat(self.discovered_since)
            except ValueError as error:
                raise SearchError("discovered_since is no ISO time") from error


@dataclass(frozen=True)
class Catalog:
    normalized: DataFrame
    lifecycle: DataFrame
    links: DataFrame
    raw: DataFrame | None = None

    def postings(self) -> DataFrame:
        """Linked postings with their lifecycle, whatever their status."""
        return self.normalized.join(self.links, KEYS).join(self.lifecycle, KEYS)

    def linked(self) -> DataFrame:
        return self.normalized.join(self.links, KEYS)

    def unlinked(self) -> DataFrame:
        return self.normalized.join(self.links, KEYS, "left_anti")

    def active(self) -> DataFrame:
        """Active linked postings; the status is filtered before the joins."""
        return self.linked().join(self.lifecycle.filter("status = 'active'"), KEYS)

    def screening_inputs(self) -> DataFrame:
        """Active linked postings with their payloads."""
        return self.active().join(self.raw.select(*KEYS, "payload_json"), KEYS)

    def stored(self) -> DataFrame:
        return self.normalized.join(self.raw.select(*KEYS, "payload_json"), KEYS)

    def get(self, source: str, scope: str, job_id: str) -> DataFrame:
        """One posting with its payload and state, or no row."""
        one = (F.col("source") == source) & (F.col("source_scope") == scope) & (F.col("source_job_id") == job_id)
        return self.stored().filter(one).join(self.lifecycle.filter(one), KEYS, "left").join(self.links.filter(one), KEYS, "left")

    def has_active(self) -> DataFrame:
        """(logical_job_id, active): whether any posting of an entity is active; unknown entities have no row."""
        return self.links.join(self.lifecycle, KEYS).groupBy("logical_job_id").agg(F.bool_or(F.col("status") == "active").alias("active"))


def matches(criteria: CatalogCriteria) -> Column:
    """What one posting has to hold."""
    terms, mode = parse_keywords(criteria.keywords, criteria.mode)
    parts = [keyword_match(terms, mode, FIELDS[criteria.fields])] if terms else []
    if not criteria.include_inactive:
        parts.append(F.col("status") == "active")
    if criteria.source != "all":
        parts.append(F.col("source") == criteria.source)
    parts += [F.coalesce(contains_term(F.col(c), v), F.lit(False)) for c in ("company", "location") if (v := getattr(criteria, c))]
    parts += [F.col(c) == v for c in ("employment_type", "workplace_type") if (v := getattr(criteria, c))]
    if criteria.discovered_since:
        parts.append(F.col("first_seen_at") >= F.to_timestamp(F.lit(criteria.discovered_since)))
    return reduce(and_, parts) if parts else F.lit(True)


def entities(postings: DataFrame) -> DataFrame:
    """One row for each logical entity of judged postings (KEYS, title, company, status, outcome and times).

    Title and company are those of the first posting, by key, of the best active outcome, or of the first
    posting of all if that is exclude or none is active. A least struct is combined on the map side, so a large entity is no task of its own.
    """
    active = F.col("status") == "active"
    priority = active_priority(F.col("status"), F.col("outcome"))
    first = F.struct((-priority).alias("p"), *KEYS, "title", "company")
    found = postings.groupBy("logical_job_id").agg(
        F.min(first).alias("f"), F.min("first_seen_at").alias("first_seen"), F.max("last_seen_at").alias("last_seen"),
        F.max(F.when(active, priority)).alias("r"), F.min(F.when(active, F.col("posted_at"))).alias("posted_at"),
    )
    return found.select(F.col("logical_job_id").alias("id"), F.col("f.title").alias("title"), F.col("f.company").alias("company"), "first_seen", "last_seen", outcome_of(F.col("r")).alias("outcome"), "posted_at")


@dataclass(frozen=True)
class Results:
    """Lazy parts of a search: all matching entities in no order, their number, and one page with details."""

    matched: DataFrame
    total: DataFrame
    page: DataFrame


def search_catalog(catalog: Catalog, judge: Callable[[DataFrame], DataFrame], criteria: CatalogCriteria, *, page: int = 1, page_size: int = 25) -> Results:
    """judge adds `outcome` and `reasons` to postings; only siblings of matching postings are judged."""
    criteria.check()
    if page < 1 or page_size not in PAGE_SIZES:
        raise SearchError("pages count from 1 and hold 25, 50 or 100 rows")
    postings = catalog.postings()
    candidates = postings.filter(matches(criteria)).select("logical_job_id").distinct()
    judged = judge(postings.join(candidates, "logical_job_id", "left_semi"))
    matched = entities(judged)
    if criteria.outcome != "all":
        matched = matched.filter(F.col("outcome") == criteria.outcome)
    order = [*SORTS[criteria.sort](), F.asc("id")]
    shown = matched.orderBy(*order).offset((page - 1) * page_size).limit(page_size)
    # Details are looked up for the page's entities only: at most page_size rows, so they may be broadcast.
    names = ["title", "company", "location", "job_url", "apply_url", "description", "employment_type", "workplace_type", "status", "outcome", "reasons"]
    detail = F.struct(*KEYS, *names)
    ids = shown.select(F.col("id").alias("logical_job_id"))
    of_page = judge(postings.join(F.broadcast(ids), "logical_job_id", "left_semi"))  # not all candidates a second time
    details = of_page.groupBy(F.col("logical_job_id").alias("id")).agg(F.array_sort(F.collect_list(detail)).alias("representations"))
    return Results(matched, matched.agg(F.count(F.lit(1)).alias("total")), shown.join(details, "id").orderBy(*order))


def clamp_page(page: int, total: int, page_size: int = 25) -> int:
    """The page nearest to the one asked for that has rows; 1 if there are none."""
    return max(1, min(page, -(-total // page_size)))
