"""Decisions and entities of a store, kept up to date by judging only what has changed.

Of each linked posting three hashes are stored: of its texts, of all that a decision depends on (the texts, its
entity, its payload and the rules), and of its other columns. A full outer join of the hashes tells new, deleted and
changed postings. Only those with new input are judged; the others carry their decisions. Only entities that such a
posting belongs to, or has belonged to, are summed up again. Partitions without a change are not written.
"""

from __future__ import annotations

import hashlib
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.lineage import cut
from ledgerline.operators import sync
from ledgerline.operators.catalog import KEYS, SORTS, Catalog, CatalogCriteria, entities, matches
from ledgerline.operators.judging import judged
from ledgerline.operators.policy import Policy
from ledgerline.operators.store import Store

#: Raised whenever the code of a judgement changes, so that all postings are judged again.
RULES_VERSION = 1
#: Partitions of the table of entities, and the most scopes whose partitions are named one by one.
BUCKETS, NAMED = 64, 1000
TEXT = ["title", "description", "company", "location"]
METADATA = ["logical_job_id", *TEXT[:1], "company", "location", "status", "first_seen_at", "last_seen_at", "inactive_at", "retrieved_at", "employment_type", "workplace_type", "posted_at"]
DECISIONS = ["rejected", "outcome", "reasons"]


@dataclass(frozen=True)
class Counts:
    scanned: int = 0
    text: int = 0
    screened: int = 0
    metadata_updated: int = 0
    deleted: int = 0

    @property
    def changed(self) -> bool:
        return self.text + self.screened + self.metadata_updated + self.deleted > 0


def rules_print(rules: Policy) -> str:
    """What decisions depend on besides a posting."""
    return hashlib.sha256(repr((RULES_VERSION, sorted(asdict(rules).items()))).encode()).hexdigest()


def bucket(entity: Column) -> Column:
    return F.pmod(F.xxhash64(entity), F.lit(BUCKETS)).cast("int")


def _linked(catalog: Catalog) -> DataFrame:
    return catalog.postings().join(catalog.raw, KEYS)


def synchronize(store: Store, rules: Policy) -> Counts:
    """Brings `judged` and `entities` up to date with the other tables; gives what had to be done.

    A repeated attempt finds what is left to do: hashes are stored with the decisions, and entities are summed up
    for all postings whose hashes differ or whose entity does not stand as it would be summed up.
    """
    now = _linked(store.catalog()).withColumn("_rules", F.lit(rules_print(rules)))
    texts = {c: F.coalesce(F.col(c), F.lit("")) for c in TEXT}
    hashes = sync.hashed(now.withColumns(texts), KEYS, TEXT, ["logical_job_id", "payload_json", "_rules"], METADATA)
    before = store.table("judged")
    kinds = sync.changes(before.select(*KEYS, "text_hash", "input_hash", "metadata_hash"), hashes, KEYS)
    ids = before.select(*KEYS, F.col("logical_job_id").alias("old_id")).join(now.select(*KEYS, F.col("logical_job_id").alias("new_id")), KEYS, "full_outer")
    found = cut(kinds.join(ids, KEYS))  # keys, class and entities; counted, and joined with three times
    sums = found.agg(F.count_if(F.col("change") != "deleted").alias("scanned")).crossJoin(sync.counters(found)).first()
    counts = Counts(*(int(sums[c] or 0) for c in ("scanned", "text", "screened", "metadata_updated", "deleted")))
    if not counts.changed:
        return counts
    todo = found.filter("change <> 'same'")
    scopes = [tuple(r) for r in todo.select("source", "source_scope").distinct().limit(NAMED + 1).collect()]
    some = scopes if len(scopes) <= NAMED else None
    old = store.table("judged", some)
    touched = lambda df: df.join(todo.select("source", "source_scope").distinct(), ["source", "source_scope"], "left_semi")
    fresh = judged(now.join(todo.filter("change in ('new', 'text', 'screen')").select(*KEYS), KEYS, "left_semi"), rules)
    carried = touched(now).join(found.filter("change in ('same', 'metadata')").select(*KEYS), KEYS, "left_semi").join(old.select(*KEYS, *DECISIONS), KEYS)
    columns = [c for c in before.columns if not c.endswith("_hash")]
    after = fresh.select(columns).unionByName(carried.select(columns)).join(hashes, KEYS)
    affected = cut(todo.select(F.explode(F.array_compact(F.array("old_id", "new_id"))).alias("id")).distinct())
    # Entities first: were they last, an attempt that fails between would leave nothing that tells that they are due.
    whole = after.unionByName(store.table("judged").join(todo.select("source", "source_scope").distinct(), ["source", "source_scope"], "left_anti"))
    whole = cut(whole.join(affected.select(F.col("id").alias("logical_job_id")), "logical_job_id", "left_semi"))
    _replace_entities(store, affected, entities(whole))
    store.replace("judged", touched(old), cut(after))
    return counts


def _replace_entities(store: Store, affected: DataFrame, summed: DataFrame) -> None:
    buckets = affected.select(bucket(F.col("id")).alias("bucket")).distinct()
    old = store.table("entities").filter(F.col("bucket").isin([r["bucket"] for r in buckets.collect()]))
    stay = old.join(affected, "id", "left_anti")
    store.replace("entities", old, stay.unionByName(summed.withColumn("bucket", bucket(F.col("id")))))


def search(store: Store, criteria: CatalogCriteria) -> DataFrame:
    """All matching entities in order, from the stored decisions; nothing is judged."""
    criteria.check()
    wanted = store.catalog().postings().filter(matches(criteria)).select(F.col("logical_job_id").alias("id"))
    found = store.table("entities").join(wanted, "id", "left_semi").drop("bucket")
    kept = found if criteria.outcome == "all" else found.filter(F.col("outcome") == criteria.outcome)
    return kept.orderBy(*SORTS[criteria.sort](), F.asc("id"))
