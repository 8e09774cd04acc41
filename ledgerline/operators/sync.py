"""What changed between two versions of a table, and what has to be done again for it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.functions.text import fingerprint


def hashed(rows: DataFrame, keys: list[str], text: list[str], inputs: list[str], metadata: list[str]) -> DataFrame:
    """Keys with text_hash, input_hash and metadata_hash."""
    made = {f"{name}_hash": fingerprint(*(F.col(c).cast("string") for c in columns)) for name, columns in (("text", text), ("input", [*text, *inputs]), ("metadata", metadata))}
    return rows.select(*keys, *(e.alias(n) for n, e in made.items()))


def changes(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Keys and class: new, deleted, text, screen, metadata or same, by one full outer join of the hashes."""
    a = old.select(*keys, *(F.col(f"{h}_hash").alias(f"old_{h}") for h in ("text", "input", "metadata")))
    joined = a.join(new, keys, "full_outer")
    kind = (
        F.when(F.col("old_text").isNull(), "new")
        .when(F.col("text_hash").isNull(), "deleted")
        .when(F.col("old_text") != F.col("text_hash"), "text")
        .when(F.col("old_input") != F.col("input_hash"), "screen")
        .when(F.col("old_metadata") != F.col("metadata_hash"), "metadata")
        .otherwise("same")
    )
    return joined.select(*keys, kind.alias("change"))


def counters(classes: DataFrame) -> DataFrame:
    """One row: texts written, rows screened, metadata updates of known rows, deletes."""
    has = lambda *k: F.count_if(F.col("change").isin(*k))
    return classes.agg(has("new", "text").alias("text"), has("new", "text", "screen").alias("screened"), has("text", "screen", "metadata").alias("metadata_updated"), has("deleted").alias("deleted"))
