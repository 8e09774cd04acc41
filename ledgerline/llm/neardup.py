"""Near duplicates by MinHash with tensored banding, confirmed on full shingle sets.

Signatures. Two small collections of `groups` group hashes are made, each of `width` minhashes. A
table key joins one group of either collection, so groups**2 tables of 2 * width minhashes cost only
2 * groups * width minhashes: the square root of what independent tables need. With 8 groups of 2,
32 minhashes serve 64 tables of 4, and a pair at similarity 0.85 is missed by all with probability
2 * (1 - 0.85**2)**8 = 7e-5.

Keys. A key can be shared only if both its halves are, so the 2 * groups halves of all documents are
counted first, and keys are made of shared halves only.

Classes. Texts with equal shingle sets form a class, represented by its smallest id; only
representatives get keys. Links between classes are searched in this order:

1. In every bucket each member is compared with the bucket's smallest member. That alone joins most
   groups of near copies, at one comparison a member and bucket.
2. Components are formed. Of the documents in buckets that still hold two components, those shingles
   are counted that no other such document has. They can be in no link, so size and count bound the
   similarity to any other document, exactly. Who cannot reach the threshold is done.
3. The others are compared with the member of their bucket that has the least share of such shingles,
   mostly what the copies were made from. Components are formed again.
4. Each document that is left is compared once more with that member of its bucket, the hub, to count
   what they share. Two members have in common at most the less of what they share with the hub and
   the less of the rest that is not theirs alone: a bound that also tells apart copies of copies.
5. All pairs of a bucket in different components whose bound allows a link are compared. No bucket is
   capped; pairs within a component, and pairs that their bounds exclude, are never made, and a pair
   that shares several tables is made in the first of them only.

A comparison counts common shingles on full sets.
Sets are kept only for members of buckets with two classes or more.

Defined results: a text without words has an empty set, 0 shingles and its own component; fewer than
five words make one shingle of the whole sequence; rows that repeat an id are one node, whatever their
texts, and have its component in common; a null id stays alone with a null component; only id and text are read, so other columns cannot clash; an
empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.llm import words as W
from ledgerline.llm.components import components
from ledgerline.llm.scratch import Scratch

#: Shingles that are worked on at once, which bounds a worker's memory.
BLOCK = 1_000_000


def shingle_set(raw: bytes | None, k: int) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles, A to Z in lower case."""
    h = W.hashes(W.split((raw or b"").lower()))
    if not len(h):
        return np.empty(0, np.uint64)
    return np.unique(W.runs(h, min(k, len(h)), seed=min(k, len(h))))


def signatures(sets: list[np.ndarray], groups: int, width: int) -> np.ndarray:
    """The 2 * groups group hashes of each non-empty set."""
    starts = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    every = np.concatenate(sets)
    rng = np.random.default_rng(20240229)
    out = np.zeros((2 * groups, len(sets)), np.uint64)
    for g in range(2 * groups):
        for _ in range(width):
            odd, add = (int(x) for x in rng.integers(1, 1 << 63, 2))
            least = np.minimum.reduceat(every * np.uint64(odd | 1) + np.uint64(add), starts)
            out[g] = W.mix(out[g] * np.uint64(31) + least)
    return out.T.view(np.int64)


def sign(docs: DataFrame, k: int, groups: int, width: int) -> DataFrame:
    """doc_id, n_shingles, class_key (equal for equal sets) and halves, the group hashes."""

    def made(ids: list, sets: list[np.ndarray]) -> pa.RecordBatch:
        full = [i for i, s in enumerate(sets) if len(s)]
        halves: list = [None] * len(sets)
        if full:
            for i, row in zip(full, signatures([sets[i] for i in full], groups, width).tolist(), strict=True):
                halves[i] = row
        keys = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else f"empty {i}".encode() for i, s in zip(ids, sets, strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.binary()), pa.array(halves, pa.list_(pa.int64()))], names=["doc_id", "n_shingles", "class_key", "halves"])

    def batches(it):
        for batch in it:
            ids, sets, size = [], [], 0
            for i, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids.append(i)
                sets.append(shingle_set(x.as_py(), k))
                size += len(sets[-1])
                if size >= BLOCK:
                    yield made(ids, sets)
                    ids, sets, size = [], [], 0
            if ids:
                yield made(ids, sets)

    return docs.mapInArrow(batches, "doc_id bigint, n_shingles bigint, class_key binary, halves array<bigint>")


def full_sets(docs: DataFrame, k: int) -> DataFrame:
    def batches(it):
        for batch in it:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                sets = [shingle_set(x.as_py(), k).view(np.int64) for x in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["doc_id", "shingles"])

    return docs.mapInArrow(batches, "doc_id bigint, shingles array<bigint>")


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80, groups: int = 8, width: int = 2) -> DataFrame:
    """doc_id, n_shingles, component_id and kept (the first of its component) of each document."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "neardup")
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("_raw"))
    signed = scratch.keep(sign(texts, shingle, groups, width), "signed")
    named = signed.filter("doc_id is not null")  # a null id is in no class and represents none
    classes = named.groupBy("class_key").agg(F.min(F.struct("doc_id", "n_shingles", "halves")).alias("r"), F.count(F.lit(1)).alias("size"))
    classes = scratch.keep(classes.select("class_key", F.col("r.doc_id").alias("doc_id"), F.col("r.n_shingles").alias("n"), F.col("r.halves").alias("halves"), "size"), "classes")
    members = classes.filter("halves is not null").select("doc_id", "n", "halves")
    half = members.select("doc_id", "n", F.posexplode("halves").alias("g", "h"))
    both = half.groupBy("g", "h").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("g", "h")
    having = half.join(both, ["g", "h"], "left_semi").groupBy("doc_id", "n").agg(F.map_from_entries(F.collect_set(F.struct("g", "h"))).alias("halves"))
    of = lambda i: F.element_at("halves", i)
    chosen = lambda low: F.filter(F.map_keys("halves"), lambda g: (g < groups) if low else (g >= groups))
    keys = F.explode(F.flatten(F.transform(chosen(True), lambda i: F.transform(chosen(False), lambda j: F.struct((i * groups + j - groups).alias("table"), F.xxhash64(i, j, of(i), of(j)).alias("key"))))))
    keyed = scratch.keep(having.select(keys.alias("k"), "doc_id", "n").select("k.table", "k.key", "doc_id", "n"), "keyed")
    shared = keyed.groupBy("key").agg(F.min(F.struct("doc_id", "n")).alias("hub"), F.count(F.lit(1)).alias("size")).filter("size > 1").select("key", "hub")
    # Members of buckets with two classes or more; the others need nothing further.
    buckets = scratch.keep(keyed.select("key", "table", "doc_id", "n").join(shared, "key"), "buckets")
    sets = scratch.keep(full_sets(texts.join(buckets.select("doc_id").distinct(), "doc_id", "left_semi"), shingle), "sets")

    def possible(n: Column, m: Column, own_n: Column = F.lit(0), own_m: Column = F.lit(0)) -> Column:
        """Sizes, and counts of shingles that are no other's, that allow the similarity."""
        most = F.least(n - own_n, m - own_m)
        return most * 100 >= (n + m - most) * percent

    def confirmed(pairs: DataFrame) -> DataFrame:
        """(a, b) pairs whose full sets are similar enough."""
        left = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("sa"))
        right = sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("sb"))
        common = F.size(F.array_intersect("sa", "sb"))
        return pairs.join(left, "a").join(right, "b").withColumn("c", common.cast("long")).filter(F.col("c") * 100 >= (F.size("sa") + F.size("sb") - F.col("c")) * percent).select("a", "b")

    def ordered(pairs: DataFrame) -> DataFrame:
        return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()

    def labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
        """Members of buckets with two components or more, with their components."""
        found = rows.join(labels.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
        mixed = found.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo < hi").select("key")
        return found.join(mixed, "key", "left_semi")

    tried = scratch.keep(ordered(buckets.filter((F.col("doc_id") != F.col("hub.doc_id")) & possible(F.col("n"), F.col("hub.n"))).select(F.col("doc_id").alias("a"), F.col("hub.doc_id").alias("b"))), "tried")
    links = scratch.keep(confirmed(tried), "stars")
    rest = scratch.keep(labelled(buckets.select("key", "table", "doc_id", "n"), components(links, scratch, "first")), "rest")
    # Shingles that one document of the rest has alone.
    held = sets.join(rest.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", F.explode("shingles").alias("s"))
    alone = held.groupBy("s").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("c")).filter("c = 1").groupBy("doc_id").agg(F.count(F.lit(1)).alias("own"))
    # An id with several sets has none alone: its counts would be those of all its sets.
    alone = alone.join(sets.groupBy("doc_id").agg(F.count(F.lit(1)).alias("c")).filter("c > 1"), "doc_id", "left_anti")
    able = rest.join(alone, "doc_id", "left").withColumn("own", F.coalesce("own", F.lit(0))).filter((F.col("n") - F.col("own")) * 100 >= F.col("n") * percent)
    able = scratch.keep(able, "able")
    purest = able.groupBy("key").agg(F.min(F.struct((F.col("own") / F.col("n")).alias("share"), "doc_id", "n", "own", "component")).alias("hub"))
    again = able.join(purest, "key").filter((F.col("component") != F.col("hub.component")) & possible(F.col("n"), F.col("hub.n"), F.col("own"), F.col("hub.own")))
    again = scratch.keep(ordered(again.select(F.col("doc_id").alias("a"), F.col("hub.doc_id").alias("b"))).join(tried, ["a", "b"], "left_anti"), "again")
    links = scratch.keep(links.unionByName(confirmed(again)), "links")
    left = scratch.keep(labelled(able.drop("component"), components(links, scratch, "second")), "left")
    hubs = left.groupBy("key").agg(F.min(F.struct((F.col("own") / F.col("n")).alias("share"), "doc_id")).alias("h")).select("key", F.col("h.doc_id").alias("hub"))
    left = scratch.keep(left.join(hubs, "key"), "hubbed")
    sized = left.select("doc_id", "hub").distinct().join(sets.select("doc_id", "shingles"), "doc_id").join(sets.select(F.col("doc_id").alias("hub"), F.col("shingles").alias("of_hub")), "hub")
    # Written before it is grouped, so that AQE can split the join of a hub of very many copies.
    sized = scratch.keep(sized.select("doc_id", "hub", F.size(F.array_intersect("shingles", "of_hub")).cast("long").alias("common")), "sized")
    sized = sized.groupBy("doc_id", "hub").agg(F.max("common").alias("most"), F.min("common").alias("least"))
    # Of what is not its own, the most that the hub may have, and the most of the rest.
    free = F.col("n") - F.col("own")
    left = left.join(sized, ["doc_id", "hub"]).withColumns({"inner": F.least("most", free), "outer": free - F.least("least", free)})
    left = left.join(members.select("doc_id", "halves"), "doc_id")

    def same(first: int) -> Column:
        """The first group hash of a collection that a pair has in common, from 0."""
        equal = F.zip_with(F.slice("halves", first + 1, groups), F.slice("halves_b", first + 1, groups), lambda x, y: x == y)
        return F.array_position(equal, F.lit(True)) - 1

    once = F.col("table") == same(0) * groups + same(groups)  # of the tables that a pair shares, in the first
    other = left.select("key", F.col("halves").alias("halves_b"), F.col("doc_id").alias("b"), F.col("n").alias("m"), F.col("inner").alias("inner_m"), F.col("outer").alias("outer_m"), F.col("component").alias("d"))
    most = F.least("inner", "inner_m") + F.least("outer", "outer_m")
    across = left.withColumnRenamed("doc_id", "a").join(other, "key").filter((F.col("a") < F.col("b")) & (F.col("component") != F.col("d")) & (most * 100 >= (F.col("n") + F.col("m") - most) * percent) & once)
    more = confirmed(scratch.keep(across.select("a", "b").distinct().join(tried.unionAll(again), ["a", "b"], "left_anti"), "across"))
    # An id whose rows have several texts is in several classes, which it links.
    several = named.groupBy("doc_id").agg(F.min("class_key").alias("lo"), F.max("class_key").alias("hi")).filter("lo < hi").select("doc_id")
    joined = named.select("doc_id", "class_key").join(several, "doc_id", "left_semi").join(classes.select("class_key", F.col("doc_id").alias("node")), "class_key").select(F.col("doc_id").alias("a"), F.col("node").alias("b"))
    every = scratch.keep(links.unionByName(more).unionByName(joined), "every")
    final = components(every, scratch, "final")
    # Classes whose component is not the only member itself; written, so that AQE can split the join of a large class.
    moved = classes.join(final.withColumnRenamed("node", "doc_id"), "doc_id", "left").filter("size > 1 or component is not null")
    moved = scratch.keep(moved.select("class_key", F.coalesce("component", "doc_id").alias("component")), "moved")
    scratch.drop("classes", "keyed", "buckets", "sets", "tried", "stars", "rest", "able", "again", "links", "left", "hubbed", "sized", "across", "every")
    out = named.select("doc_id", "n_shingles", "class_key").join(moved, "class_key", "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
    out = out.unionAll(signed.filter("doc_id is null").select("doc_id", "n_shingles", F.lit(None).cast("long").alias("component_id")))
    return out.select("doc_id", "n_shingles", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))
