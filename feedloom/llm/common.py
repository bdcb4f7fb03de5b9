"""Shared plumbing: the shared folder, written intermediate tables, connected components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


_own_dirs: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Where it is unset, a local run (tests) gets a new local folder;
    on a cluster that is an error, since executors would each write to a disk of their own. The session has a folder of its own there, which is deleted when it ends."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if not held.isDefined() and not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        found = held.get() if held.isDefined() else "file://" + tempfile.mkdtemp(prefix="feedloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    own = f"{found.rstrip('/')}/feedloom-{spark.sparkContext.applicationId}"
    if own not in _own_dirs:
        # results read these tables as long as the session lives, so they go with it
        jvm = spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(own)
        fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        fs.mkdirs(path)
        fs.deleteOnExit(path)
        _own_dirs.add(own)
    return own


def written(df: DataFrame, *partition_by: str) -> DataFrame:
    """df written as Parquet to the shared folder and read back: cuts lineage and survives a lost executor."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Bytes of rows that go to Python at once, room for two slices of text (textcore.CHUNK_BYTES), and rows that a task takes from Parquet at once.
BATCH_BYTES, READ_ROWS = 7_800_000, 512


def bounded_batches(spark: SparkSession) -> None:
    """From now on this session's rows go to Python in batches of about BATCH_BYTES, or one larger row, and come from Parquet READ_ROWS at a time,
    unless it has bounds of its own. By default 10,000 rows or 64 MB go at once, and each task holds that in several copies, in the JVM's
    buffers and the worker, in and out; and 4,096 texts of a few KB come from Parquet in one array."""
    for key, value in (("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES), ("spark.sql.parquet.columnarReaderBatchSize", READ_ROWS)):
        if spark.conf.get(key, None) is None:
            spark.conf.set(key, str(value))


def column(name: str) -> Column:
    """The column of exactly that name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def default_parallelism(spark: SparkSession) -> int:
    """Buckets for keyed work: the session's shuffle partitions."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, component) of every node of the undirected edges; component is the smallest node reachable.

    Alternating large-star and small-star steps: every step takes a minimum per node, which Spark combines
    before its shuffle, and joins it back; the rows of a hub meet one row there, sorted and not held, and adaptive execution
    splits a partition that a hub makes too large. Nulls and loops
    carry no link and are left out; an empty input gives an empty result. Each round is written to the shared
    folder; the rounds grow with the logarithm of the longest path.
    """
    u, v = F.greatest(a, b).alias("u"), F.least(a, b).alias("v")
    e = written(edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).select(u, v).distinct())
    mark = F.struct(F.count("*").alias("n"), F.coalesce(F.sum(F.xxhash64("u", "v").bitwiseAND(0xFFFFFFFF)), F.lit(0)).alias("s"))
    seen = None
    for _ in range(max_rounds):
        now = tuple(e.agg(mark.alias("m")).first()["m"])
        if now == seen or not now[0]:
            break
        seen = now
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = written(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = e.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return e.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component")).unionByName(roots)
