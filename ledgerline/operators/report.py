"""Counts over a catalog: by scope, funnels of cumulative exclusions, overlaps, reasons, and algebra of id sets."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce
from itertools import combinations
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.functions.text import collapse


def percent(part: Column, whole: Column, digits: int = 2) -> Column:
    """0 of nothing is 0."""
    return F.when(whole == 0, F.lit(0.0)).otherwise(F.round(part * 100.0 / whole, digits))


def by_scope(rows: DataFrame, levels: list[str], **counts: Column) -> DataFrame:
    """n and the counts of rows that hold each condition, for the first level, for all levels, and in total."""
    sets = [[F.col(levels[0])], [F.col(x) for x in levels], []]
    return rows.groupingSets(sets, *levels).agg(F.count(F.lit(1)).alias("n"), *(F.count_if(c).alias(k) for k, c in counts.items()))


def counters(rows: DataFrame, source: str, kept: Column, linked: Column) -> DataFrame:
    """One row: postings, sources, kept, unlinked and kept_percent."""
    n, k = F.count(F.lit(1)), F.count_if(kept)
    return rows.agg(n.alias("postings"), F.count_distinct(source).alias("sources"), k.alias("kept"), F.count_if(~linked).alias("unlinked"), percent(k, n).alias("kept_percent"))


def outcome_counters(rows: DataFrame, by: list[str], outcome: str = "outcome") -> DataFrame:
    """Entities and their outcomes for each value of `by`, an entity's outcome being the best of its rows there."""
    best = rows.groupBy(*by, "logical_job_id").agg(F.max(F.array_position(F.array(F.lit("exclude"), F.lit("defer"), F.lit("keep")), F.col(outcome))).alias("r"))
    return best.groupBy(*by).agg(F.count(F.lit(1)).alias("entities"), *(F.count_if(F.col("r") == k).alias(o) for k, o in ((1, "exclude"), (2, "defer"), (3, "keep"))))


def shared_groups(rows: DataFrame, group: str, of: str = "source") -> DataFrame:
    """(group, sources): groups that several sources hold."""
    return rows.groupBy(group).agg(F.count_distinct(of).alias("sources")).filter("sources > 1")


def content_groups(rows: DataFrame, text: str, key: str) -> DataFrame:
    """(fingerprint, n, first key) of texts that are equal but for case and white space."""
    return rows.withColumn("fingerprint", text_print(F.col(text))).groupBy("fingerprint").agg(F.count(F.lit(1)).alias("n"), F.min(key).alias("first_id"))


def text_print(c: Column) -> Column:
    """SHA-256 of a text in lower case with single ASCII spaces."""
    return F.sha2(F.trim(F.regexp_replace(F.lower(c), r"[ \t\n\x0b\f\r]+", " ")), 256)


def funnel(rows: DataFrame, entity: Column, masks: Mapping[str, Column]) -> DataFrame:
    """One row: eligible entities, how many each exclusion removes after those before it, and how many remain.

    An entity stays while any of its rows does. One aggregate by entity, with map-side combining.
    """
    names, conditions = list(masks), list(masks.values())
    stays = [F.max(F.when(reduce(or_, conditions[: k + 1]), 0).otherwise(1)).alias(f"m{k}") for k in range(len(names))]
    groups = rows.groupBy(entity.alias("_entity")).agg(*stays)
    removed = [F.count_if((F.col(f"m{k}") == 0) & ((F.col(f"m{k - 1}") == 1) if k else F.lit(True))).alias(name) for k, name in enumerate(names)]
    return groups.agg(F.count(F.lit(1)).alias("eligible"), *removed, F.count_if(F.col(f"m{len(names) - 1}") == 1).alias("remaining"))


def standalone(rows: DataFrame, entity: Column, masks: Mapping[str, Column]) -> DataFrame:
    """One row: how many entities each exclusion would remove alone."""
    groups = rows.groupBy(entity.alias("_entity")).agg(*(F.bool_and(m).alias(k) for k, m in masks.items()))
    return groups.agg(*(F.count_if(F.col(k)).alias(k) for k in masks))


def overlaps(rows: DataFrame, masks: Mapping[str, Column]) -> DataFrame:
    """One row: for each pair of masks, a_and_b, how many rows hold both."""
    return rows.agg(*(F.count_if(masks[a] & masks[b]).alias(f"{a}_and_{b}") for a, b in combinations(masks, 2)))


def reason_counts(decided: DataFrame, top: int | None = None) -> DataFrame:
    """(field, kind, term, n) of decisions; with top, the most frequent ones, ties by label."""
    found = decided.select(F.explode("reasons").alias("r")).groupBy("r.field", "r.kind", "r.term").agg(F.count(F.lit(1)).alias("n"))
    return found.orderBy(F.desc("n"), "field", "kind", "term").limit(top) if top else found


def reason_label(field: Column, kind: Column, term: Column) -> Column:
    return F.concat(field, F.lit("/"), kind, F.coalesce(F.concat(F.lit(" ('"), term, F.lit("')")), F.lit("")))


def rejected(active: DataFrame, eligible: DataFrame, key: str) -> DataFrame:
    """Ids that are active and not eligible, once each."""
    return active.select(key).subtract(eligible.select(key))


def both(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return a.select(key).intersect(b.select(key))


def changed_without(rows: DataFrame, source: str) -> DataFrame:
    """Entities that are kept, but not if a source is left out."""
    kept = rows.filter("outcome = 'keep'")
    return kept.select("logical_job_id").subtract(kept.filter(F.col("source") != source).select("logical_job_id"))


def combined(*batches: DataFrame) -> DataFrame:
    """The rows of all batches, by name; columns that a batch lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), batches)


def sample(rows: DataFrame, n: int, seed: int, key: str) -> DataFrame:
    """n rows without replacement; the seed and the rows' keys decide, whatever the partitions."""
    return rows.orderBy(F.xxhash64(F.lit(seed), key), key).limit(n)


def shown(c: Column, chars: int = 320) -> Column:
    return F.substring(collapse(c), 1, chars)


def shown_time(ts: Column, hours: int = -8) -> Column:
    """A UTC time at a fixed offset on a 12-hour clock; nulls are Unknown."""
    return F.coalesce(F.date_format(ts + F.make_interval(hours=F.lit(hours)), "yyyy-MM-dd hh:mm a"), F.lit("Unknown"))


def shown_date(ts: Column) -> Column:
    """The day of a UTC time; nulls are Unknown."""
    return F.coalesce(F.date_format(ts, "yyyy-MM-dd"), F.lit("Unknown"))


def first_of(companies: DataFrame, n: int) -> DataFrame:
    """The first n entries of a registry, by position."""
    if n < 0:
        raise ValueError("n must not be negative")
    return companies.orderBy("position").limit(n)


def write_report(parts: Mapping[str, DataFrame], folder: str, *, samples: Mapping[str, DataFrame] | None = None, size: int = 10, seed: int = 0, key: str = "logical_job_id") -> None:
    """Each part as JSON lines in a folder of its own, and for each of `samples` `size` rows without replacement.

    Parts are counters and funnels, a row or a few; samples are taken by a top-k over hashed keys.
    """
    for name, part in parts.items():
        part.coalesce(1).write.mode("overwrite").json(f"{folder}/{name}")
    for name, rows in (samples or {}).items():
        sample(rows, size, seed, key).coalesce(1).write.mode("overwrite").json(f"{folder}/sample_{name}")
