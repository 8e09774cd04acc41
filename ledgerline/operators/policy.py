"""Literal-term policies: parsing, per-row reasons in policy order, and decisions."""

from __future__ import annotations

import hashlib
import tomllib
from dataclasses import dataclass
from functools import lru_cache

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from ledgerline.functions.text import let, text_key

#: A field with more terms than this is searched for all of them at once.
MANY = 24
#: Stands for any included term among the places of excluded ones.
INCLUDED = -1

#: Tables of a policy file and the lists that each must have.
LAYOUT = {"title": ("include_any", "exclude_any"), "location": ("include_any", "exclude_any"), "company": ("exclude",), "description": ("include_any", "exclude_any")}


class PolicyError(ValueError):
    """A policy file that breaks the layout."""


@dataclass(frozen=True)
class Policy:
    title_include: tuple[str, ...] = ()
    title_exclude: tuple[str, ...] = ()
    company_exclude: tuple[str, ...] = ()
    description_include: tuple[str, ...] = ()
    description_exclude: tuple[str, ...] = ()
    sha256: str = ""


def parse_policy(raw: bytes) -> Policy:
    try:
        found = tomllib.loads(raw.decode("utf-8"))
    except (UnicodeDecodeError, tomllib.TOMLDecodeError) as error:
        raise PolicyError(f"not TOML: {error}") from error
    if set(found) != {"version", *LAYOUT}:
        raise PolicyError(f"keys differ: {sorted(set(found) ^ {'version', *LAYOUT})}")
    if found["version"] != 1 or isinstance(found["version"], bool):
        raise PolicyError("version must be 1")
    for name, lists in LAYOUT.items():
        if not isinstance(found[name], dict) or set(found[name]) != set(lists):
            raise PolicyError(f"[{name}] must have exactly {', '.join(lists)}")
        for key in lists:
            values = found[name][key]
            if not isinstance(values, list) or not all(isinstance(v, str) and v.strip() for v in values):
                raise PolicyError(f"{name}.{key} must hold non-blank strings")
            if name == "location" and values:
                raise PolicyError("location lists must be empty")
    t, c, d = found["title"], found["company"], found["description"]
    return Policy(tuple(t["include_any"]), tuple(t["exclude_any"]), tuple(c["exclude"]), tuple(d["include_any"]), tuple(d["exclude_any"]), hashlib.sha256(raw).hexdigest())


def _reason(field: str, kind: str, term: str | None) -> Column:
    return F.struct(F.lit(field).alias("field"), F.lit(kind).alias("kind"), F.lit(term).cast("string").alias("term"))


def _key(term: str) -> Column:
    """The same folding as the columns'; a literal, which Spark folds once."""
    return text_key(F.lit(term))


def reasons(field: str, normal: Column, include: tuple[str, ...], exclude: tuple[str, ...]) -> Column:
    """Reasons of one field: each excluded term that occurs, in order, and one if no included term does."""
    found = [F.when(F.contains(normal, _key(t)), _reason(field, "exclude_match", t)) for t in exclude]
    if include:
        hit = F.lit(False)
        for t in include:
            hit = hit | F.contains(normal, _key(t))
        found.append(F.when(~hit, _reason(field, "no_include_match", None)))
    empty = F.array().cast("array<struct<field:string,kind:string,term:string>>")
    return F.array_compact(F.array(*found)) if found else empty


@lru_cache(maxsize=8)
def _automaton(exclude: tuple[str, ...], include: tuple[str, ...]) -> ahocorasick.Automaton:
    """All terms in one machine; each leads to its places, as two terms may have one key."""
    found: dict[str, set[int]] = {}
    for k, term in enumerate(exclude):
        found.setdefault(term, set()).add(k)
    for term in include:
        found.setdefault(term, set()).add(INCLUDED)
    made = ahocorasick.Automaton()
    for term, places in found.items():
        made.add_word(term, tuple(places))
    made.make_automaton()
    return made


def many(normal: Column, exclude: tuple[str, ...], include: tuple[str, ...]) -> Column:
    """The places, ascending, of the excluded terms that a text holds, and INCLUDED if it holds an included one.

    One pass over the text, however many terms there are, in Arrow batches. Texts and terms are keys already.
    """

    @F.pandas_udf(ArrayType(IntegerType()))
    def hits(texts: pd.Series) -> pd.Series:
        machine = _automaton(exclude, include)
        return texts.map(lambda t: sorted({k for _, places in machine.iter(t) for k in places}), na_action="ignore")

    return hits(normal)


def _keys(rows: DataFrame, terms: tuple[str, ...]) -> tuple[str, ...]:
    """Terms as the JVM folds them."""
    if not terms:
        return ()
    return tuple(rows.sparkSession.range(1).select(F.transform(F.array(*map(F.lit, terms)), text_key).alias("k")).first()["k"])


def _reasons_of(hits: Column, field: str, include: tuple[str, ...], exclude: tuple[str, ...]) -> Column:
    """The same as `reasons`, from the places of terms; of null texts nothing is found."""
    terms = F.array(*map(F.lit, exclude)) if exclude else F.array().cast("array<string>")
    known = F.coalesce(hits, F.array().cast("array<int>"))
    out = F.transform(F.filter(known, lambda k: k >= 0), lambda k: F.struct(F.lit(field).alias("field"), F.lit("exclude_match").alias("kind"), F.get(terms, k).alias("term")))
    if not include:
        return out
    none = F.when(hits.isNotNull() & ~F.array_contains(known, F.lit(INCLUDED)), F.array(_reason(field, "no_include_match", None)))
    return F.concat(out, F.coalesce(none, F.array().cast("array<struct<field:string,kind:string,term:string>>")))


def decide(rows: DataFrame, policy: Policy, *, title: str = "title", company: str | None = "company", description: str = "description") -> DataFrame:
    """The rows with reasons, ordered title, company, description, and rejected, which replace columns of these names.

    The decision is one expression over the normalised texts, so that a filter on it normalises once. The terms of a
    field that has MANY are looked for in one pass over each text.
    """
    kept = [F.col(f"`{c}`") for c in rows.columns if c.lower() not in ("reasons", "rejected")]
    lists = {"title": (policy.title_exclude, policy.title_include), "description": (policy.description_exclude, policy.description_include)}
    large = [f for f, (exclude, include) in lists.items() if len(exclude) + len(include) > MANY]
    normal = F.struct(text_key(F.col(title)).alias("title"), text_key(F.col(description)).alias("description"), (text_key(F.col(company)) if company else F.lit("")).alias("company"))
    # A dispatcher in IT is no dispatcher.
    spares = any(" ".join(t.split()).casefold() == "dispatcher" for t in policy.title_exclude)

    def of_field(n: Column, field: str) -> Column:
        exclude, include = lists[field]
        return _reasons_of(n[f"{field}_hits"], field, include, exclude) if field in large else reasons(field, n[field], include, exclude)

    def decided(n: Column) -> Column:
        by_title = of_field(n, "title")
        if spares:
            kept = F.filter(by_title, lambda r: ~F.coalesce(text_key(r["term"]) == "dispatcher", F.lit(False)))
            by_title = F.when(n["title"] == "it dispatcher", kept).otherwise(by_title)
        parts = [by_title]
        if policy.company_exclude:
            parts.append(F.array_compact(F.array(*[F.when(n["company"] == _key(t), _reason("company", "exclude_match", t)) for t in policy.company_exclude])))
        parts.append(of_field(n, "description"))
        return F.concat(*parts)

    if large:
        found = rows.select(*kept, normal.alias("__normal"))
        for field in large:
            exclude, include = (_keys(rows, x) for x in lists[field])
            found = found.withColumn(f"__{field}", many(F.col(f"__normal.{field}"), exclude, include))
        merged = F.struct("__normal.*", *(F.col(f"__{f}").alias(f"{f}_hits") for f in large))
        return found.select(*kept, let(merged, decided).alias("reasons")).withColumn("rejected", F.size("reasons") > 0)
    return rows.select(*kept, let(normal, decided).alias("reasons")).withColumn("rejected", F.size("reasons") > 0)
