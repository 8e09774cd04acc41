"""What rows of the catalog's tables must hold, as arrays of violations, and a gate that fails on the first one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEYS = ["source", "source_scope", "source_job_id"]
#: Classes of employment and workplace, and states of a posting.
EMPLOYMENT = ("full_time", "part_time", "internship", "contract", "temporary", "other", "unknown")
WORKPLACE = ("remote", "hybrid", "onsite", "unknown")
STATUS = ("active", "inactive")
_BLANK = r"(?U)^[\s\x1c-\x1f]*$"


def blank(c: Column) -> Column:
    """Null, empty, or white space alone."""
    return c.isNull() | c.rlike(_BLANK)


def web_url(c: Column) -> Column:
    """Whether a text is an HTTP(S) URL with a host and without white space; null is none."""
    return F.coalesce(c.rlike(r"(?iU)^https?://[^/?#\s\x1c-\x1f]+[^\s\x1c-\x1f]*$"), F.lit(False))


def _named(**wrong: Column) -> Column:
    return F.array_compact(F.array(*[F.when(F.coalesce(v, F.lit(False)), F.lit(k)) for k, v in wrong.items()]))


def posting_violations() -> Column:
    """Of a normalised posting."""
    optional = {c: F.col(c).isNotNull() & ~F.col(c).isin(*known) for c, known in (("employment_type", EMPLOYMENT), ("workplace_type", WORKPLACE))}
    return _named(
        **{c: blank(F.col(c)) for c in (*KEYS, "company", "title")}, description=F.col("description").isNull(), job_url=~web_url(F.col("job_url")),
        apply_url=F.col("apply_url").isNotNull() & ~web_url(F.col("apply_url")), location=F.col("location").isNotNull() & blank(F.col("location")), retrieved_at=F.col("retrieved_at").isNull(), **optional,
    )


def payload_violations() -> Column:
    """Of a raw record: its payload is a JSON object that is not empty."""
    parsed = F.try_parse_json("payload_json")
    objects = F.coalesce(F.schema_of_variant(parsed).startswith("OBJECT"), F.lit(False))
    return _named(**{c: blank(F.col(c)) for c in KEYS}, payload_json=~objects | (F.schema_of_variant(parsed) == "OBJECT<>"), retrieved_at=F.col("retrieved_at").isNull())


def lifecycle_violations() -> Column:
    """Of a posting's state: its times are in order, and only an inactive one has an end."""
    active = F.col("status") == "active"
    return _named(
        **{c: blank(F.col(c)) for c in KEYS}, status=F.col("status").isNull() | ~F.col("status").isin(*STATUS),
        first_seen_at=F.col("first_seen_at").isNull() | (F.col("first_seen_at") > F.col("last_seen_at")), last_seen_at=F.col("last_seen_at").isNull(),
        inactive_at=F.when(active, F.col("inactive_at").isNotNull()).otherwise(F.col("inactive_at").isNull() | (F.col("inactive_at") < F.col("last_seen_at"))),
    )


def checked(rows: DataFrame, violations: Column, what: str) -> DataFrame:
    """The rows; reading the id of one that violates something is an error that names it. Partitions can still be pruned."""
    key = F.concat_ws("/", *(F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in KEYS))
    bad = F.concat(F.lit(f"{what} "), key, F.lit(": "), F.array_join(violations, ", "))
    # Within a value, not a filter: a filter's parts may be evaluated in any order.
    return rows.withColumn(KEYS[2], F.when(F.size(violations) == 0, F.col(KEYS[2])).otherwise(F.raise_error(bad).cast("string")))
