"""The algebra of outcomes, and postings summed up to logical entities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Outcomes by rising priority.
OUTCOMES = ("exclude", "defer", "keep")


def rank(outcome: Column, strict: bool = True) -> Column:
    """0, 1 or 2; an unknown outcome is an error, or 0 if not strict."""
    known = F.array_position(F.array(*map(F.lit, OUTCOMES)), outcome)
    unknown = F.raise_error(F.concat(F.lit("unknown outcome: "), F.coalesce(outcome, F.lit("null")))).cast("int") if strict else F.lit(0)
    return F.when(known > 0, (known - 1).cast("int")).otherwise(unknown)


def outcome_of(value: Column) -> Column:
    """Of a rank; none is exclude."""
    return F.element_at(F.array(*map(F.lit, OUTCOMES)), F.coalesce(value, F.lit(0)) + 1)


def active_priority(status: Column, outcome: Column) -> Column:
    """The rank by which an entity's representative is chosen. Inactive rows rank like excluded ones, so that among these the first key counts."""
    return F.when(status == "active", rank(outcome, strict=False)).otherwise(F.lit(0))


def combined(rejected: Column, screened: Column) -> Column:
    return F.when(rejected, F.lit("exclude")).otherwise(screened)


def by_logical(rows: DataFrame) -> DataFrame:
    """logical_id and outcome, the highest of its rows."""
    return rows.groupBy("logical_id").agg(F.max(rank(F.col("outcome"))).alias("r")).select("logical_id", outcome_of(F.col("r")).alias("outcome"))


def summary(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each logical_id of postings (keys, status, outcome, first_seen, last_seen, posted_at).

    The representative is the first row, by keys, of the highest priority among active rows; where that is
    exclude, or none is active, the first row of all. Only active rows count for the outcome and posted_at. A least struct
    replaces the ranked window, so that a large entity is combined on the map side.
    """
    active = F.col("status") == "active"
    priority = active_priority(F.col("status"), F.col("outcome"))
    first = F.struct((-priority).alias("p"), *keys, "title")
    return rows.groupBy("logical_id").agg(
        F.min(first).alias("f"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"),
        F.max(F.when(active, priority)).alias("r"), F.min(F.when(active, F.col("posted_at"))).alias("posted_at"), F.count(F.lit(1)).alias("n_rows"),
    ).select("logical_id", F.col("f.title").alias("title"), *(F.col(f"f.{k}").alias(f"rep_{k}") for k in keys), "first_seen", "last_seen", outcome_of(F.col("r")).alias("outcome"), "posted_at", "n_rows")


def representative(rows: DataFrame, order: list[Column]) -> DataFrame:
    """The first row of each logical_id, by a ranked window that Spark limits before the shuffle."""
    return rows.withColumn("rn", F.row_number().over(Window.partitionBy("logical_id").orderBy(*order))).filter("rn = 1").drop("rn")
