"""Cutting lineage in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where that is unset, a folder of our own in local sessions and an error on a cluster, whose
    executors cannot read the driver's folders."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isDefined():
        return context._jsc.sc().getCheckpointDir().get()
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found is None:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="lattica-")
    context.setCheckpointDir(found)
    return context._jsc.sc().getCheckpointDir().get()


#: Spark's setting by which a query's shuffles are deleted when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def _cleaned(spark: SparkSession) -> Iterator[None]:
    """The shuffles of queries that run meanwhile go as they end; otherwise they stay until the driver's garbage is
    collected, so that those of all steps add up."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


def checkpointed(df: DataFrame) -> DataFrame:
    """df as a table written once in the shared folder and read again: its size is known to later joins, also after many
    rounds, and it survives lost executors. The shuffles that made it are deleted."""
    spark = df.sparkSession
    path = f"{folder(spark)}/{uuid.uuid4().hex}"
    with _cleaned(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
