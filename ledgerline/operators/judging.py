"""Policy, geography and screening together: one outcome and its reasons for each posting."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.operators import geography, outcomes, policy, screening
from ledgerline.operators.catalog import KEYS, Catalog

#: Columns that judging adds.
ADDED = ["rejected", "filter_reasons", "screening_outcome", "screening_reasons", "evidence", "geography", "outcome", "reasons"]


def judged(rows: DataFrame, rules: policy.Policy) -> DataFrame:
    """The rows (source, title, company, location, description, payload_json) with what ADDED names.

    A rejected posting is excluded; else the screening decides, in which geography can only exclude. Each step is
    one expression over the row, so there is no shuffle; payload_json may be null.
    """
    kept = [F.col(f"`{c}`") for c in rows.columns if c.lower() not in ADDED]
    decided = policy.decide(rows.select(*kept), rules).withColumnRenamed("reasons", "filter_reasons")
    assessed = screening.screen(geography.assess(decided, name="_geography"), assessment="_geography", whole=True)
    named = F.transform("filter_reasons", lambda r: F.concat(F.lit("filter:"), r["field"], F.lit("/"), r["kind"]))
    return assessed.select(
        *kept, "rejected", "filter_reasons",
        F.col("screening.outcome").alias("screening_outcome"), F.col("screening.reasons").alias("screening_reasons"), F.col("screening.evidence").alias("evidence"), F.col("screening.geography").alias("geography"),
        outcomes.combined(F.col("rejected"), F.col("screening.outcome")).alias("outcome"), F.concat(named, "screening.reasons").alias("reasons"),
    )


def judge(catalog: Catalog, rules: policy.Policy) -> Callable[[DataFrame], DataFrame]:
    """For `search_catalog`: looks up the payloads of the postings that it is given, and judges them."""
    payloads = catalog.raw.select(*KEYS, "payload_json") if catalog.raw is not None else None

    def added(rows: DataFrame) -> DataFrame:
        with_payload = rows.join(payloads, KEYS, "left") if payloads is not None else rows.withColumn("payload_json", F.lit(None).cast("string"))
        return judged(with_payload, rules)

    return added


def screen_catalog(catalog: Catalog, rules: policy.Policy) -> DataFrame:
    """All active linked postings, judged."""
    return judge(catalog, rules)(catalog.active())


def logical_outcomes(screened: DataFrame) -> DataFrame:
    """(logical_id, outcome): the best outcome of each entity's postings."""
    return outcomes.by_logical(screened.select(F.col("logical_job_id").alias("logical_id"), "outcome"))


def eligible(screened: DataFrame) -> DataFrame:
    """(logical_job_id, first posting by key) of entities with a posting that the policy does not reject."""
    return screened.filter("not rejected").groupBy("logical_job_id").agg(F.min(F.struct(*KEYS)).alias("first_posting"))


def category_masks(categories: tuple[str, ...]) -> dict[str, Column]:
    """For funnels over judged rows: whether a category is among the screening's reasons."""
    return {c: F.array_contains("screening_reasons", c) for c in categories}
