"""A run from sources to eligible entities: acquire, reconcile, resolve identity, filter; and what it counts.

Each step is written before the next begins, so that a later failure keeps what is done, and a repeated run goes on
from there. A source is read once: its answers are cut off from the source before they are looked at. Rows are counted
by observations of the writes themselves.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ledgerline.lineage import cut
from ledgerline.operators import identity, judging, normalise, policy
from ledgerline.operators.catalog import KEYS
from ledgerline.operators.store import SCOPE, Store

NORMALISE = {"lever": normalise.lever, "greenhouse": normalise.greenhouse}


@dataclass(frozen=True)
class Batch:
    """Of one provider: scopes that were asked, those that succeeded, postings, and why others failed."""

    attempted: int = 0
    successful: int = 0
    acquired: int = 0
    failures: tuple[tuple[str, str], ...] = ()


@dataclass(frozen=True)
class Processed:
    resolved: int = 0
    created: int = 0
    evaluated: int = 0
    rejected: int = 0
    eligible: int = 0


@dataclass(frozen=True)
class Run:
    batches: Mapping[str, Batch] = field(default_factory=dict)
    catalog: Processed = Processed()

    @property
    def acquired(self) -> int:
        return sum(b.acquired for b in self.batches.values())


def acquire(store: Store, provider: str, read: DataFrame, companies: Mapping[str, str]) -> Batch:
    """Reconciles what a source gave (source, source_scope, retrieved_at, payload_json, error): whole snapshots alone.

    A scope with an error, a posting that violates the rules, or a snapshot that is not newer fails by itself.
    companies names the company of each scope; a registry is as long as its list.
    """
    given = cut(read)
    failed = {r["source_scope"]: r["error"] for r in given.filter("error is not null").select("source_scope", "error").collect()}
    headers = given.filter("error is null").groupBy(*SCOPE).agg(F.max("retrieved_at").alias("retrieved_at"))
    names = F.create_map(*[F.lit(x) for pair in companies.items() for x in pair]) if companies else F.lit(None).cast("map<string,string>")
    payloads = given.filter("payload_json is not null").select("source_scope", names[F.col("source_scope")].alias("company"), "retrieved_at", "payload_json")
    whole, broken = normalise.snapshots(cut(NORMALISE[provider](payloads)))
    failed |= {r["source_scope"]: "violations: " + ", ".join(r["violations"]) for r in broken.collect()}
    stale = headers.join(store.table("scope_state"), SCOPE).filter("retrieved_at <= last_retrieved_at").select("source_scope").collect()
    failed |= {r["source_scope"]: "snapshot is not newer" for r in stale if r["source_scope"] not in failed}
    good = headers.filter(~F.col("source_scope").isin(list(failed))) if failed else headers
    n = store.reconcile(whole.join(good.select(*SCOPE), SCOPE, "left_semi"), good)
    return Batch(len(companies), len(companies) - len(failed), n, tuple(sorted(failed.items())))


def identity_rows(store: Store) -> DataFrame:
    """Postings with their links, as identity takes them."""
    rows = store.table("normalized").join(store.table("links").select(*KEYS, "logical_job_id"), KEYS, "left")
    return rows.select("source", F.col("source_scope").alias("scope"), F.col("source_job_id").alias("id"), "company", "job_url", "apply_url", F.col("logical_job_id").alias("logical_id"), "title", "location", "description")


def resolve(store: Store) -> tuple[int, int]:
    """Links all postings that have no entity; gives how many, and how many of them are new entities."""
    counted = Observation()
    found = identity.resolve(identity_rows(store)).observe(counted, F.count(F.lit(1)).alias("resolved"), F.count_if(~F.col("matched")).alias("created"))
    links = found.select("source", F.col("scope").alias("source_scope"), F.col("id").alias("source_job_id"), F.col("logical_id").alias("logical_job_id"), F.current_timestamp().alias("linked_at"))
    store.assign(cut(links))
    seen = counted.get
    return seen["resolved"], seen["created"]


def process(store: Store, rules: policy.Policy, decisions: str | None = None) -> Processed:
    """Resolves identity, and filters all active linked postings. With `decisions`, a folder, they are written there.

    The counts are observed on the one pass that decides; eligible entities are counted after it by their ids.
    """
    resolved, created = resolve(store)
    counted = Observation()
    rows = store.catalog().active().select(*KEYS, "logical_job_id", "title", "company", "description")
    decided = policy.decide(rows, rules).observe(counted, F.count(F.lit(1)).alias("evaluated"), F.count_if("rejected").alias("rejected"))
    kept = decided.select(*KEYS, "logical_job_id", "rejected", "reasons")
    if decisions:
        kept.write.mode("overwrite").parquet(decisions)
        kept = store.spark.read.schema(kept.schema).parquet(decisions)
    else:
        kept = cut(kept)
    eligible = judging.eligible(kept).count()
    seen = counted.get
    return Processed(resolved, created, seen["evaluated"], seen["rejected"], eligible)


def run(store: Store, sources: Mapping[str, tuple[DataFrame, Mapping[str, str]]], rules: policy.Policy, decisions: str | None = None) -> Run:
    """All providers, one after the other in the order given, and the whole catalog processed once after them."""
    batches = {provider: acquire(store, provider, read, companies) for provider, (read, companies) in sources.items()}
    return Run(batches, process(store, rules, decisions))
