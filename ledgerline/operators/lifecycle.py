"""Complete snapshots into current state: active, inactive and when each was seen."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def fresh_headers(headers: DataFrame, checkpoints: DataFrame) -> DataFrame:
    """(scope, at) headers that are strictly newer than their scope's checkpoint."""
    return headers.join(checkpoints.select("scope", "last_at"), "scope", "left").filter(F.col("last_at").isNull() | (F.col("at") > F.col("last_at"))).select("scope", "at")


def reconcile(state: DataFrame, rows: DataFrame, headers: DataFrame) -> DataFrame:
    """The state (scope, id, status, first_seen, last_seen, inactive_at) after one snapshot of each header's scope.

    rows (scope, id) are the snapshots' postings. A scope without a header is left alone; one whose header
    has no rows becomes inactive as a whole. One full outer join on the natural key.
    """
    new = rows.select("scope", "id").distinct().join(headers, "scope").withColumnRenamed("at", "seen")
    joined = state.join(new, ["scope", "id"], "full_outer").join(headers, "scope", "left")
    here, gone = F.col("seen").isNotNull(), F.col("seen").isNull() & F.col("at").isNotNull() & (F.col("status") == "active")
    return joined.select(
        "scope",
        "id",
        F.when(here, "active").when(gone, "inactive").otherwise(F.col("status")).alias("status"),
        F.coalesce("first_seen", "seen").alias("first_seen"),
        F.coalesce("seen", "last_seen").alias("last_seen"),
        F.when(here, None).when(gone, F.col("at")).otherwise(F.col("inactive_at")).alias("inactive_at"),
    )


def replay(log: DataFrame) -> DataFrame:
    """The state after all snapshots of a log (scope, id, at) in which each scope's times are its snapshots.

    The same as reconciling one by one: an id is inactive from the scope's first snapshot behind its last.
    """
    times = log.select("scope", "at").distinct().withColumn("next_at", F.lead("at").over(Window.partitionBy("scope").orderBy("at")))
    seen = log.groupBy("scope", "id").agg(F.min("at").alias("first_seen"), F.max("at").alias("last_seen"))
    out = seen.join(times.withColumnRenamed("at", "last_seen"), ["scope", "last_seen"])
    return out.select("scope", "id", F.when(F.col("next_at").isNull(), "active").otherwise("inactive").alias("status"), "first_seen", "last_seen", F.col("next_at").alias("inactive_at"))


def advance(state: DataFrame, log: DataFrame) -> DataFrame:
    """The state (scope, id, status, first_seen, last_seen, inactive_at) after all snapshots of a log (scope, id, at).

    The log is newer than the state; a row with a null id is the header of a snapshot without postings. As if the
    snapshots were reconciled one by one: an id is inactive from the scope's first snapshot behind the last that has it.
    """
    times = log.select("scope", "at").distinct().withColumn("next_at", F.lead("at").over(Window.partitionBy("scope").orderBy("at")))
    first = times.groupBy("scope").agg(F.min("at").alias("began"))
    seen = log.filter("id is not null").groupBy("scope", "id").agg(F.min("at").alias("new_first"), F.max("at").alias("new_last"))
    seen = seen.join(times.withColumnRenamed("at", "new_last"), ["scope", "new_last"])
    joined = state.join(seen, ["scope", "id"], "full_outer").join(first, "scope", "left")
    here = F.col("new_last").isNotNull()
    gone = ~here & F.col("began").isNotNull() & (F.col("status") == "active")
    return joined.select(
        "scope",
        "id",
        F.when(here, F.when(F.col("next_at").isNull(), "active").otherwise("inactive")).when(gone, "inactive").otherwise(F.col("status")).alias("status"),
        F.coalesce("first_seen", "new_first").alias("first_seen"),
        F.coalesce("new_last", "last_seen").alias("last_seen"),
        F.when(here, F.col("next_at")).when(gone, F.col("began")).otherwise(F.col("inactive_at")).alias("inactive_at"),
    )


def stale(log: DataFrame, order: str, *, ranges: int = 1024) -> DataFrame:
    """Entries of a log (scope, at, order) that are not newer than all before them in their scope.

    The order is cut into ranges of equal width by its least and greatest value. The maxima of all ranges before
    an entry's own come from a table of scopes x ranges; only within (scope, range) is there a running window,
    so that a scope with most of the log is many tasks.
    """
    low, high = log.agg(F.min(order), F.max(order)).first()
    span = (high - low) // ranges + 1 if low is not None else 1
    cut = log.withColumn("_range", F.floor((F.col(order) - F.lit(low)) / F.lit(span)).cast("int"))
    before = Window.partitionBy("scope").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    past = cut.groupBy("scope", "_range").agg(F.max("at").alias("_max")).select("scope", "_range", F.max("_max").over(before).alias("_past"))
    own = Window.partitionBy("scope", "_range").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    known = cut.withColumn("_own", F.max("at").over(own)).join(past, ["scope", "_range"])
    return known.withColumn("newest", F.greatest("_own", "_past")).filter(F.col("at") <= F.col("newest")).drop("_range", "_own", "_past")


def reactivations(log: DataFrame) -> DataFrame:
    """(scope, id, returns): how often an id came back after a snapshot of its scope without it."""
    number = log.select("scope", "at").distinct().withColumn("n", F.row_number().over(Window.partitionBy("scope").orderBy("at")))
    seen = log.select("scope", "id", "at").distinct().join(number, ["scope", "at"])
    gap = F.col("n") - F.lag("n").over(Window.partitionBy("scope", "id").orderBy("n"))
    return seen.withColumn("gap", gap).groupBy("scope", "id").agg(F.count_if(F.col("gap") > 1).alias("returns")).filter("returns > 0")
