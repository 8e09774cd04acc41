"""Cutting a plan's lineage in the folder that all machines of a cluster share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Only a local session without it, as in tests, is given a folder; a cluster must name one."""
    context = spark.sparkContext
    found = context.getCheckpointDir() or context.getConf().get("spark.checkpoint.dir")
    if not found and not context.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
    if not context.getCheckpointDir():
        found = found or f"file://{tempfile.mkdtemp(prefix='spark-shared-')}"
        context.setCheckpointDir(found)
    return found.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """The rows, computed once and read from the shared folder from now on; lost executors cost no more than their readers."""
    shared_folder(df.sparkSession)
    return df.checkpoint()
