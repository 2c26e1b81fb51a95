"""Cutting the lineage of iterative jobs through the shared checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is the session's ``spark.checkpoint.dir``. Only a session on one machine (a ``local`` master, as in tests) may
    leave it unset: then a temporary folder is made and set as the checkpoint folder. On a cluster a folder of the
    driver's machine would be no shared one, so that raises.
    """
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="spark-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder; a later loss of executors then recomputes nothing before it."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder for a table or files of one run."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a compressed table in the shared folder, read back: like ``cut``, at a fraction of the space.

    For tables of many short rows or of compressible bytes, which a checkpoint would hold uncompressed.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def removed(spark: SparkSession, path: str) -> None:
    """Delete a folder that ``scratch_path`` named, through Spark's own file systems."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def setting(spark: SparkSession, key: str, value: str):
    """A setting of the session holds inside and is as it was before afterwards."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def shuffles_end_with_queries(spark: SparkSession):
    """Shuffle files go at the end of each query inside, not when the driver collects its garbage.

    For loops whose rounds are written tables, so that nothing needs an earlier round's shuffle again.
    """
    return setting(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


def joined_where_they_lie(spark: SparkSession):
    """Tables that are bucketed by the first of several keys are joined and summed by all of them without an exchange."""
    return setting(spark, "spark.sql.requireAllClusterKeysForCoPartition", "false")
