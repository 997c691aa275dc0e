"""Cutting lineage in a way that survives the loss of executors.

Tables written and read again, and checkpoints, go to the folder that ``spark.checkpoint.dir``
names, which driver and executors share.  A folder of this machine is taken only where the
master is a local one, as in tests; anywhere else a missing setting is an error.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: list[str] = []


def _shared_folder(spark: SparkSession) -> str:
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise ValueError(f"spark.checkpoint.dir must name a folder that driver and executors share (master: {master})")
    if not _LOCAL:
        _LOCAL.append(tempfile.mkdtemp(prefix="hourloom-"))
        atexit.register(shutil.rmtree, _LOCAL[0], ignore_errors=True)
    return _LOCAL[0]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path for a table written and read again, in the cluster's shared folder."""
    return f"{_shared_folder(spark).rstrip('/')}/{uuid.uuid4().hex}/{name}"


def stored(df: DataFrame, name: str = "table", partitions: int | None = None) -> DataFrame:
    """The rows, written as a Parquet table to the shared folder and read again."""
    path = scratch_path(df.sparkSession, name)
    (df if partitions is None else df.coalesce(partitions)).write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, *paths: str) -> None:
    """Removes scratch tables that are not read any more."""
    for path in paths:
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def durable(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(_shared_folder(spark))
    return df.checkpoint()
