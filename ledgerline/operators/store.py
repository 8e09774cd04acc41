"""The catalog's current state as Parquet tables, changed by snapshots, links and deletions.

A table lies in a folder of the root, in partitions by source and scope. A change reads the partitions of the
scopes that it touches, computes their new rows by joins, and overwrites these partitions alone, when all rows are
written. Large scopes are written by several tasks. Of a change to several tables the checkpoint of scopes is the
last to be written, and every step gives the same rows again, so an attempt that fails on the way is repeated as a
whole: a snapshot counts once its checkpoint is there. One writer at a time is the caller's to see to.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.operators import rows as checks
from ledgerline.operators.catalog import KEYS, Catalog
from ledgerline.operators.lifecycle import reconcile

SCOPE = KEYS[:2]
_KEY = "source string, source_scope string, source_job_id string"
SCHEMAS = {
    "raw": f"{_KEY}, retrieved_at timestamp, payload_json string",
    "normalized": f"{_KEY}, company string, title string, description string, location string, job_url string, apply_url string, posted_at timestamp, employment_type string, workplace_type string, retrieved_at timestamp",
    "lifecycle": f"{_KEY}, status string, first_seen_at timestamp, last_seen_at timestamp, inactive_at timestamp",
    "links": f"{_KEY}, logical_job_id string, linked_at timestamp",
    "scope_state": "source string, source_scope string, last_retrieved_at timestamp",
    # Derived from the others: every linked posting with its decisions and hashes, and every entity.
    "judged": f"{_KEY}, logical_job_id string, title string, company string, status string, first_seen_at timestamp, last_seen_at timestamp, posted_at timestamp, rejected boolean, outcome string, reasons array<string>, text_hash string, input_hash string, metadata_hash string",
    "entities": "bucket int, id string, title string, company string, first_seen timestamp, last_seen timestamp, outcome string, posted_at timestamp",
}
PARTITIONS = dict.fromkeys(SCHEMAS, SCOPE) | {"entities": ["bucket"]}


class StoreError(ValueError):
    """A change that the store refuses; nothing has been written."""


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def create(self) -> Store:
        """Makes the tables that are not there; those that are stay as they are."""
        for name, schema in SCHEMAS.items():
            self.spark.createDataFrame([], schema).write.mode("ignore").partitionBy(*PARTITIONS[name]).parquet(f"{self.root}/{name}")
            system, path = self._path(f"{self.root}/{name}")
            system.mkdirs(path)
        return self

    def table(self, name: str, scopes: list[tuple[str, str]] | None = None) -> DataFrame:
        """A table, or the partitions of some scopes; no other is listed."""
        columns = [c.split()[0] for c in SCHEMAS[name].split(", ")]  # the reader puts those of partitions last
        found = self.spark.read.schema(SCHEMAS[name]).parquet(f"{self.root}/{name}").select(columns)
        return found if scopes is None else found.filter(_among(scopes))

    def catalog(self) -> Catalog:
        """For searching. Rows that violate the tables' rules are errors when they are read."""
        return Catalog(
            checks.checked(self.table("normalized"), checks.posting_violations(), "stored posting"), checks.checked(self.table("lifecycle"), checks.lifecycle_violations(), "stored state"),
            self.table("links").drop("linked_at"), self.table("raw").drop("retrieved_at"),
        )

    def reconcile(self, postings: DataFrame, headers: DataFrame, *, stale: str = "error") -> int:
        """Takes in one whole snapshot of each header's scope; gives the number of postings taken in.

        headers (source, source_scope, retrieved_at) name the snapshots, also empty ones. postings have the columns of
        `normalized` but for the metadata, which are null where they are missing, and payload_json. A snapshot that is
        not newer than its scope's checkpoint is refused, or left out with stale="skip". Postings that are there are
        replaced, those that a snapshot lacks become inactive, and other scopes are not touched.
        """
        last = self.table("scope_state")
        known = headers.select(*SCOPE, "retrieved_at").join(last, SCOPE, "left").withColumn("fresh", F.col("last_retrieved_at").isNull() | (F.col("retrieved_at") > F.col("last_retrieved_at")))
        # A run names its snapshots one by one: the list is as long as what it fetched.
        found = known.collect()
        if len({(h["source"], h["source_scope"]) for h in found}) < len(found):
            raise StoreError("a scope has several headers")
        old = [f"{h['source']}/{h['source_scope']}" for h in found if not h["fresh"]]
        if old and stale == "error":
            raise StoreError(f"snapshots are not newer than their scopes: {', '.join(sorted(old)[:5])}")
        scopes = [(h["source"], h["source_scope"]) for h in found if h["fresh"]]
        if not scopes:
            return 0
        new_headers = known.filter("fresh").select(*SCOPE, "retrieved_at")
        new = self._new(postings, headers, scopes)
        n = self._verify(new, postings, headers, scopes)
        for name in ("raw", "normalized"):
            columns = self.table(name).columns
            kept = self.table(name, scopes).join(new.select(*KEYS), KEYS, "left_anti")
            self._overwrite(name, kept.select(columns).unionByName(new.select(columns)))
        scope = F.struct(*SCOPE)
        state = self.table("lifecycle", scopes).select(scope.alias("scope"), F.col("source_job_id").alias("id"), "status", F.col("first_seen_at").alias("first_seen"), F.col("last_seen_at").alias("last_seen"), "inactive_at")
        after = reconcile(state, new.select(scope.alias("scope"), F.col("source_job_id").alias("id")), new_headers.select(scope.alias("scope"), F.col("retrieved_at").alias("at")))
        self._overwrite("lifecycle", after.select("scope.source", "scope.source_scope", F.col("id").alias("source_job_id"), "status", F.col("first_seen").alias("first_seen_at"), F.col("last_seen").alias("last_seen_at"), "inactive_at"))
        self._overwrite("scope_state", new_headers.withColumnRenamed("retrieved_at", "last_retrieved_at"))
        return n

    def assign(self, proposed: DataFrame) -> DataFrame:
        """Links of (KEYS, logical_job_id, linked_at): a posting that has one keeps it. Gives the links of the proposed postings.

        Of several proposals for a posting the earliest counts. A posting that is not there is an error, and nothing is linked.
        """
        first = proposed.groupBy(*KEYS).agg(F.min(F.struct("linked_at", "logical_job_id")).alias("p")).select(*KEYS, "p.logical_job_id", "p.linked_at")
        orphan = first.join(self.table("normalized").select(*KEYS), KEYS, "left_anti").limit(1).collect()
        if orphan:
            raise StoreError(f"no such posting: {'/'.join(map(str, orphan[0][:3]))}")
        new = first.join(self.table("links").select(*KEYS), KEYS, "left_anti")
        self._rebalanced(new.select(self.table("links").columns)).write.mode("append").partitionBy(*SCOPE).parquet(f"{self.root}/links")
        return self.table("links").join(proposed.select(*KEYS).distinct(), KEYS, "left_semi")

    def delete(self, keys: DataFrame) -> None:
        """Removes postings (KEYS) with their payload, state and link; entities without postings go with their links."""
        scopes = [tuple(r) for r in keys.select(*SCOPE).distinct().collect()]
        for name in ("links", "lifecycle", "normalized", "raw"):  # what refers to others goes first
            before = self.table(name, scopes)
            self.replace(name, before, before.join(keys.select(*KEYS), KEYS, "left_anti"))

    def _new(self, postings: DataFrame, headers: DataFrame, scopes: list[tuple[str, str]]) -> DataFrame:
        """The snapshots' postings with the tables' columns; times are the headers'."""
        missing = {c: F.lit(None).cast("timestamp" if c == "posted_at" else "string") for c in ("posted_at", "employment_type", "workplace_type") if c not in postings.columns}
        return postings.filter(_among(scopes)).drop("retrieved_at").withColumns(missing).join(headers.select(*SCOPE, "retrieved_at"), SCOPE)

    def _verify(self, new: DataFrame, postings: DataFrame, headers: DataFrame, scopes: list[tuple[str, str]]) -> int:
        """The number of new postings; an error if one violates the rules, is there twice, or has no header."""
        strays = postings.select(*SCOPE).distinct().join(headers.select(*SCOPE), SCOPE, "left_anti").limit(1).collect()
        if strays:
            raise StoreError(f"no header for {'/'.join(map(str, strays[0]))}")
        wrong = F.concat(checks.posting_violations(), F.transform(checks.payload_violations(), lambda v: F.concat(F.lit("raw."), v)))
        counts = new.select(*KEYS, wrong.alias("wrong")).groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n"), F.first("wrong").alias("wrong"))
        sums = counts.agg(F.sum("n").alias("n"), F.min(F.when((F.col("n") > 1) | (F.size("wrong") > 0), F.struct(*KEYS, "n", "wrong"))).alias("bad")).first()
        if sums["bad"]:
            bad = sums["bad"]
            raise StoreError(f"posting {'/'.join(str(bad[k]) for k in KEYS)}: {', '.join(bad['wrong']) or 'is there twice'}")
        return sums["n"] or 0

    def _rebalanced(self, df: DataFrame, columns: list[str] = SCOPE) -> DataFrame:
        """Files by partition; a partition that is large is written by several tasks."""
        return df.hint("rebalance", *(F.col(c) for c in columns))

    def _overwrite(self, name: str, df: DataFrame) -> None:
        columns = PARTITIONS[name]
        self._rebalanced(df, columns).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*columns).parquet(f"{self.root}/{name}")

    def replace(self, name: str, before: DataFrame, after: DataFrame) -> None:
        """Writes what is left of the partitions in `before`; those of which nothing is left go."""
        columns = PARTITIONS[name]
        stay = {tuple(r) for r in after.select(*columns).distinct().collect()}
        gone = [tuple(r) for r in before.select(*columns).distinct().collect() if tuple(r) not in stay]
        self._overwrite(name, after.select(self.table(name).columns))
        for values in gone:  # a partition that loses all its rows is not overwritten
            system, path = self._path(f"{self.root}/{name}/{self._partition(columns, values)}")
            system.delete(path, True)

    def _path(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(name)
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def _partition(self, columns: list[str], values: tuple) -> str:
        """The name of a partition's folder, as Spark's writer escapes it."""
        named = self.spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.getPartitionPathString
        return "/".join(named(c, str(v)) for c, v in zip(columns, values, strict=True))


def _among(scopes: list[tuple[str, str]]) -> Column:
    """On partition columns alone, so that other partitions are pruned."""
    by_source: dict[str, list[str]] = {}
    for source, scope in scopes:
        by_source.setdefault(source, []).append(scope)
    parts = [(F.col("source") == s) & F.col("source_scope").isin(found) for s, found in by_source.items()]
    return reduce(lambda a, b: a | b, parts, F.lit(False))


def checkpoints(snapshots: DataFrame) -> DataFrame:
    """(source, source_scope, last_retrieved_at): the newest time of each scope."""
    return snapshots.groupBy(*SCOPE).agg(F.max("retrieved_at").alias("last_retrieved_at"))
