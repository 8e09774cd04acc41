"""Token ids as ORC files: integer run-length encoding, row indexes, and Bloom filters on document ids.

`write` range-partitions the texts by document id, sorts each partition and encodes it, so that the files,
in the order of their names, hold the documents in ascending order. A row has the document's ids, their
number, the number of the file (`part`), and how many ids stand before it in the file (`local_start`).
The table `parts`, one row a file, has the ids before each file, so that a document's place in the whole
stream is the sum of two numbers and no stripe has to be read for another's sake.

Readers are Spark's: a file is read by as many tasks as it has splits, each with its own stripes; a filter on
document ids skips stripes by their statistics and Bloom filters and groups of STRIDE rows by the row index;
counting tokens reads the column of counts alone.

Equal ids are parted by a hash of the text as well, so that a repeated id is no partition of its own. Texts,
not ids, are shuffled: range partitioning samples its input first, and would encode twice.

Defined results: a null or empty text is the end token alone; null document ids come first; rows that repeat
an id are documents of their own, in the order of the hash of their texts; other columns are not written; an
empty table gives empty tables. A text of any length is one row.
"""

from __future__ import annotations

import zlib
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerline.llm.packing import token_ids

#: Rows of a group in the row index, bytes of a stripe, and the share of false answers of a Bloom filter.
STRIDE, STRIPE, FALSE_SHARE = 1000, 16 << 20, 0.01
#: Ids in a batch on its way to the writer.
BATCH = 1_000_000


def write(docs: DataFrame, folder: str, vocab_path: str, *, id_col: str = "doc_id", text_col: str = "text", end_id: int = 1) -> str:
    """Writes `folder`/ids and `folder`/parts and returns the folder. The id column keeps its name."""
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col), F.col(text_col).cast("binary").alias("_raw"), F.xxhash64(text_col).alias("_hash"))
    if id_col.lower() in ("part", "local_start", "n_tokens", "ids", "_raw", "_hash"):
        raise ValueError(f"{id_col} is a name of the format's own")
    names = [id_col, "part", "local_start", "n_tokens", "ids"]

    def batches(it):
        part, start = TaskContext.get().partitionId(), 0
        keys, found, held = [], [], 0

        def out(type_of):
            sizes = np.array([len(x) for x in found], np.int64)
            starts = start + np.cumsum(sizes) - sizes
            offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(found).view(np.int32)))
            return pa.RecordBatch.from_arrays([pa.array(keys, type_of), pa.array(np.full(len(keys), part, np.int32)), pa.array(starts), pa.array(sizes), ids], names=names), int(sizes.sum())

        for batch in it:
            for key, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                keys.append(key)
                found.append(token_ids(x.as_py(), vocab_path, end_id))
                held += len(found[-1])
                if held >= BATCH:
                    made, size = out(batch.column(0).type)
                    yield made
                    start, keys, found, held = start + size, [], [], 0
            if keys:
                made, size = out(batch.column(0).type)
                yield made
                start, keys, found, held = start + size, [], [], 0

    placed = rows.repartitionByRange(F.col(id_col).asc_nulls_first(), F.col("_hash")).sortWithinPartitions(F.col(id_col).asc_nulls_first(), "_hash").drop("_hash")
    encoded = placed.mapInArrow(batches, f"`{id_col}` {kind}, part int, local_start bigint, n_tokens bigint, ids array<int>")
    options = {"orc.bloom.filter.columns": id_col, "orc.bloom.filter.fpp": str(FALSE_SHARE), "orc.row.index.stride": str(STRIDE), "orc.stripe.size": str(STRIPE), "compression": "lz4"}
    encoded.write.options(**options).orc(f"{folder}/ids")
    spark = docs.sparkSession
    files = spark.read.schema(encoded.schema).orc(f"{folder}/ids").groupBy("part").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n_tokens").alias("n_tokens"), F.min(id_col).alias("first_id"), F.max(id_col).alias("last_id"))
    # One row a file: the running sum over them is a small window.
    base = F.coalesce(F.sum("n_tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    files.withColumn("base", base).coalesce(1).write.orc(f"{folder}/parts")
    return folder


def read(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.orc(f"{folder}/ids")


def parts(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.orc(f"{folder}/parts")


def lookup(spark: SparkSession, folder: str, ids: Sequence, *, id_col: str = "doc_id") -> DataFrame:
    """The rows of a few documents; stripes and groups of rows that cannot hold them are not decoded."""
    return read(spark, folder).filter(F.col(id_col).isin(*ids))


def with_start(rows: DataFrame, spark: SparkSession, folder: str) -> DataFrame:
    """rows with `part` and `local_start`, with `start` in the whole stream instead."""
    return rows.join(parts(spark, folder).select("part", "base"), "part").withColumn("start", F.col("base") + F.col("local_start")).drop("part", "base", "local_start")


def digests(spark: SparkSession, folder: str, *, id_col: str = "doc_id") -> DataFrame:
    """Each document's place in the stream, number of ids, and CRC-32 of the ids as the files give them."""
    rows = read(spark, folder).select(id_col, "part", "local_start", "ids")
    schema = f"`{id_col}` {rows.schema[id_col].dataType.simpleString()}, part int, local_start bigint, n_tokens bigint, ids_crc32 bigint"

    def batches(it):
        for batch in it:
            lists = batch.column(3)
            offsets = np.asarray(lists.offsets)
            raw = memoryview(np.ascontiguousarray(np.asarray(lists.values), "<i4")).cast("B")
            crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(3)), pa.array(np.diff(offsets).astype(np.int64)), pa.array(crc, pa.int64())], names=[id_col, "part", "local_start", "n_tokens", "ids_crc32"])

    return with_start(rows.mapInArrow(batches, schema), spark, folder)
