"""Shards by rendezvous hashing: each record goes to the shard with the highest weighted score.

A shard's score for a key is -weight / ln(u), u in (0, 1) from a hash of key and shard. Only the
key and the list of shards decide; a further shard takes rows only into itself, in proportion to its
weight. Hashes are the first 13 hex digits of MD5, so that any SQL engine gives the same shards.

Slots number a shard's rows without gaps. Rows are ranked within (shard, bucket), a bucket being a
hash of the key, and a bucket begins where the buckets before it end. The table of bucket sizes has
shards x buckets rows at most, whatever the input, so it may be broadcast; no shard is ever sorted as
a whole, and a hot source, text or value changes nothing, as only the key is hashed.

Defined results: a null key is hashed as the empty string; equal keys go to the same shard and get
slots of their own; an empty table gives an empty table; columns pass through, and `shard`, `slot`
and `grown_shard` replace input columns of these names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ranking buckets in a shard; with 16 shards, 100 billion rows give some 1.5 million rows a bucket.
BUCKETS = 4096
DIGITS = 13


def unit(key: Column, salt: str) -> Column:
    """A hash of key and salt in (0, 1)."""
    digits = F.substring(F.md5(F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit(f":{salt}"))), 1, DIGITS)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / float(16**DIGITS)


def _free(name: str, taken: set[str]) -> str:
    """The name, with as many underscores before it as it takes to be new."""
    while name.lower() in taken:
        name = f"_{name}"
    return name


def shard(rows: DataFrame, weights: Sequence[float], *, key_col: str = "doc_id", grown: float | None = None, buckets: int = BUCKETS) -> DataFrame:
    """The rows with shard and slot, and with grown_shard if a further shard of that weight is named."""
    key = F.col(f"`{key_col}`")
    taken = {c.lower() for c in rows.columns}
    scores, bucket, count, start, rank = (_free(n, taken) for n in ("_scores", "_bucket", "_n", "_start", "_rank"))
    scored = rows.withColumn(scores, F.array(*[-F.lit(float(w)) / F.log(unit(key, str(i))) for i, w in enumerate([*weights, *([grown] if grown else [])])]))
    first = F.slice(scores, 1, len(weights))
    found = {"shard": (F.array_position(first, F.array_max(first)) - 1).cast("int")}
    if grown:
        found["grown_shard"] = (F.array_position(scores, F.array_max(scores)) - 1).cast("int")
    placed = scored.withColumns(found | {bucket: F.floor(unit(key, "bucket") * buckets).cast("int")}).drop(scores)
    sizes = placed.groupBy("shard", bucket).agg(F.count(F.lit(1)).alias(count))
    before = Window.partitionBy("shard").orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("shard", bucket, F.coalesce(F.sum(count).over(before), F.lit(0)).alias(start))
    ranked = placed.withColumn(rank, F.row_number().over(Window.partitionBy("shard", bucket).orderBy(key)))
    return ranked.join(F.broadcast(starts), ["shard", bucket]).withColumn("slot", (F.col(start) + F.col(rank) - 1).cast("long")).drop(bucket, rank, start)


def write_shards(sharded: DataFrame, path: str) -> None:
    """Parquet files, one folder for each shard, rows in the order of slots within a file."""
    sharded.repartition("shard", F.floor(F.col("slot") / 1_000_000)).sortWithinPartitions("shard", "slot").write.partitionBy("shard").mode("overwrite").parquet(path)
