"""The folder that all executors share, and tables written there to cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: set[str] = set()


def file_system(spark: SparkSession, path: str):
    """Spark's file system of a path and the path as it takes it."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def shared_folder(spark: SparkSession) -> str:
    """The session's own folder below spark.checkpoint.dir, deleted when the session ends. Where that is unset, a local run (tests) gets a
    local folder; on a cluster that is an error, since every executor would write to a disk of its own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if not held.isDefined() and not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        found = held.get() if held.isDefined() else "file://" + tempfile.mkdtemp(prefix="feedloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    own = f"{found.rstrip('/')}/feedloom-{spark.sparkContext.applicationId}"
    if own not in _own:
        # results read these tables as long as the session lives, so they go with it
        fs, path = file_system(spark, own)
        fs.mkdirs(path)
        fs.deleteOnExit(path)
        _own.add(own)
    return own


def new_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """df written as Parquet to the shared folder and read back: cuts lineage and survives a lost executor."""
    path = new_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
