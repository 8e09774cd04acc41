"""Keyword and facet search over postings: predicates, sorts and pages as Column expressions."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.functions.text import ascii_fold, contains_term, let

PAGE_SIZES = (25, 50, 100)


class SearchError(ValueError):
    """A search that cannot be understood."""


@dataclass(frozen=True)
class Criteria:
    keywords: str = ""
    mode: str = "AND"
    fields: tuple[str, ...] = ("text",)
    equal: dict[str, object] = field(default_factory=dict)
    contains: dict[str, str] = field(default_factory=dict)
    at_least: dict[str, object] = field(default_factory=dict)


def parse_keywords(text: str, mode: str = "AND") -> tuple[list[str], str]:
    """Terms and mode, read character by character.

    Quotes open and close a phrase, which is taken as it is, spaces included, unless it is empty; elsewhere
    white space ends a word, and the words AND and OR, of one kind only, set the mode.
    """
    if mode not in ("AND", "OR"):
        raise SearchError("mode is AND or OR")
    terms: list[str] = []
    modes: set[str] = set()
    word, quoted = "", False

    def close(phrase: bool) -> None:
        nonlocal word
        if not phrase and word in ("AND", "OR"):
            modes.add(word)
        elif word:
            terms.append(word)
        word = ""

    for c in text:
        if c == '"':
            close(quoted)
            quoted = not quoted
        elif c.isspace() and not quoted:
            close(False)
        else:
            word += c
    if quoted:
        raise SearchError("a quote is not closed")
    close(False)
    if len(modes) > 1:
        raise SearchError("AND and OR cannot be mixed")
    return terms, modes.pop() if modes else mode


def keyword_match(terms: list[str], mode: str, fields: tuple[str, ...]) -> Column:
    """Each term, or one of them, in any field. Fields are folded once a row, however many terms there are."""

    def found(row: Column) -> Column:
        hits = [reduce(or_, [F.coalesce(F.contains(row[f"f{k}"], ascii_fold(F.lit(t))), F.lit(False)) for k in range(len(fields))]) for t in terms]
        return reduce(and_ if mode == "AND" else or_, hits)

    if len(terms) == 1 and len(fields) == 1:
        return contains_term(F.col(fields[0]), terms[0])
    return let(F.struct(*(ascii_fold(F.col(f)).alias(f"f{k}") for k, f in enumerate(fields))), found)


def predicate(criteria: Criteria) -> Column:
    """All conditions hold on one row; a term counts if any chosen field holds it."""
    terms, mode = parse_keywords(criteria.keywords, criteria.mode)
    parts = [keyword_match(terms, mode, criteria.fields)] if terms else []
    parts += [F.col(k) == v for k, v in criteria.equal.items()]
    parts += [contains_term(F.col(k), v) for k, v in criteria.contains.items()]
    parts += [F.col(k) >= F.lit(v) for k, v in criteria.at_least.items()]
    return reduce(and_, parts) if parts else F.lit(True)


def search(rows: DataFrame, criteria: Criteria) -> DataFrame:
    return rows.filter(predicate(criteria))


def page(rows: DataFrame, order: list[Column], number: int, size: int = 25) -> DataFrame:
    """One page; the order's last column must be unique. Planned as a top-k, not as a full sort."""
    if number < 1 or size not in PAGE_SIZES:
        raise SearchError("pages count from 1 and hold 25, 50 or 100 rows")
    return rows.orderBy(*order).offset((number - 1) * size).limit(size)


def nocase(name: str) -> Column:
    return ascii_fold(F.col(name))
