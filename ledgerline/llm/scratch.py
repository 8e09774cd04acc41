"""Tables in the folder that all machines of a cluster share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Held while a table is written: its shuffle files go when the write is done, and sorted buckets are read as sorted.
WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.legacy.bucketedTableScan.outputOrdering": "true"}


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where it is unset, a local session, as in tests, is given a temporary folder; a cluster is an error."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        found = f"file://{tempfile.mkdtemp(prefix='spark-shared-')}"
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def _path(spark: SparkSession, name: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def new_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the shared one, which goes when the session's JVM ends."""
    made = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    system, path = _path(spark, made)
    system.mkdirs(path)
    system.deleteOnExit(path)
    return made


@contextmanager
def writing(spark: SparkSession) -> Iterator[None]:
    before = {k: spark.conf.get(k) for k in WRITING}
    for k, v in WRITING.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def _plain(columns: Sequence[str]) -> dict[str, str]:
    return {f"parquet.enable.dictionary#{c}": "false" for c in columns}


class Scratch:
    """A folder of tables. A written table has no lineage, so lost executors cost no more than its readers."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.path, self.tables = spark, new_folder(spark, name), {}

    def keep(self, df: DataFrame, name: str, plain: Sequence[str] = ()) -> DataFrame:
        """plain: columns of hashes, for which a dictionary would be built in vain."""
        with writing(self.spark):
            df.write.options(**_plain(plain)).parquet(f"{self.path}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.path}/{name}")

    def keep_sorted(self, df: DataFrame, name: str, key: str, plain: Sequence[str] = ()) -> DataFrame:
        """In one bucket for each shuffle partition by `key`, sorted; joins of such tables on it are merges without an exchange."""
        self.tables[name] = f"scratch_{uuid.uuid4().hex}"
        with writing(self.spark):
            df.write.options(**_plain(plain)).bucketBy(int(self.spark.conf.get("spark.sql.shuffle.partitions")), key).sortBy(key).option("path", f"{self.path}/{name}").saveAsTable(self.tables[name])
        return self.spark.table(self.tables[name])

    def drop(self, *names: str) -> None:
        for name in names:
            if table := self.tables.pop(name, None):
                self.spark.sql(f"DROP TABLE IF EXISTS {table}")
            system, path = _path(self.spark, f"{self.path}/{name}")
            system.delete(path, True)
