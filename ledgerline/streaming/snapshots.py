"""A stream of snapshots into current state: an extension of `lifecycle` to logs that go on.

The stream's rows are (scope, id, at): a posting in the snapshot of its scope at a time. A snapshot without postings is
one row with a null id. All rows of a snapshot come in one micro-batch, as they do from one file; several snapshots of
a scope may come in one, and snapshots that are not newer than what the scope has had are left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ledgerline.operators.lifecycle import advance

STATE = "scope string, id string, status string, first_seen timestamp, last_seen timestamp, inactive_at timestamp"
CHECKPOINTS = "scope string, last_at timestamp"


def _version(spark: SparkSession, folder: str, batch: int, name: str, schema: str) -> DataFrame:
    """A table as it was before a micro-batch: that of the last one before it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
    system = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = [int(f.getPath().getName().removeprefix("v")) for f in system.listStatus(path)] if system.exists(path) else []
    whole = [v for v in found if v < batch and system.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}/v{v}/_SUCCESS"))]
    for v in sorted(whole)[:-2]:  # a repeated micro-batch needs the last one alone
        system.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}/v{v}"), True)
    return spark.read.schema(schema).parquet(f"{folder}/{name}/v{max(whole)}") if whole else spark.createDataFrame([], schema)


def state(spark: SparkSession, folder: str) -> DataFrame:
    """The state after the last whole micro-batch."""
    return _version(spark, folder, 1 << 62, "state", STATE)


def follow(snapshots: DataFrame, folder: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Keeps the state of a stream of snapshots below a shared folder.

    A micro-batch reads the version before it and writes its own, so that one that is repeated gives the same state. The
    checkpoints of scopes are written last; work is one full outer join on (scope, id) a micro-batch.
    """

    def take(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        kept, last = _version(spark, folder, number, "state", STATE), _version(spark, folder, number, "checkpoints", CHECKPOINTS)
        fresh = batch.join(last, "scope", "left").filter(F.col("last_at").isNull() | (F.col("at") > F.col("last_at"))).select("scope", "id", "at")
        advance(kept, fresh).write.mode("overwrite").parquet(f"{folder}/state/v{number}")
        newest = last.unionByName(batch.groupBy("scope").agg(F.max("at").alias("last_at"))).groupBy("scope").agg(F.max("last_at").alias("last_at"))
        newest.write.mode("overwrite").parquet(f"{folder}/checkpoints/v{number}")

    return snapshots.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
