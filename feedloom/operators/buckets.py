"""Tables in hash buckets of their key, of which a change reads and writes only the buckets that hold its keys.

A bucket is a folder with one folder for each of its versions; the newest counts. A change writes new versions of the buckets it touches, and what was there before
stays until it is tidied, so that readers and a repeated change find it. One writer at a time.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.shared import file_system, written
from . import dml

BUCKETS = 256
_PLACE = re.compile(r"__bucket=(\d+)/__version=(\d+)$")

Merge = Callable[[DataFrame, DataFrame], DataFrame]


def _versions(spark: SparkSession, folder: str, below: int | None = None) -> dict[int, list[int]]:
    """Versions of each bucket, the oldest first; only those below a number if one is given."""
    fs, at = file_system(spark, f"{folder}/__bucket=*/__version=*")
    out: dict[int, list[int]] = {}
    for s in fs.globStatus(at) or []:
        bucket, version = map(int, _PLACE.search(s.getPath().toString()).groups())
        if below is None or version < below:
            out.setdefault(bucket, []).append(version)
    return {b: sorted(v) for b, v in out.items()}


def _read(spark: SparkSession, folder: str, schema: T.StructType, places: list[tuple[int, int]]) -> DataFrame:
    if not places:
        return spark.createDataFrame([], schema)
    stored = T.StructType([*schema.fields, T.StructField("__live", T.BooleanType())])
    files = [f"{folder}/__bucket={b}/__version={v}" for b, v in places]
    return spark.read.schema(stored).parquet(*files).where("__live").drop("__live")


def table(spark: SparkSession, folder: str, schema: T.StructType) -> DataFrame:
    """The table as it is now; without rows before its first change."""
    return _read(spark, folder, schema, [(b, v[-1]) for b, v in _versions(spark, folder).items()])


def change(rows: DataFrame, folder: str, schema: T.StructType, key: list[str], merge: Merge, buckets: int = BUCKETS, version: int | None = None) -> list[int]:
    """Puts merge(the touched buckets' rows, rows) in those buckets' place and says which they are.

    ``version`` numbers the change (one more than all so far by default): the same change done again, whole or after it broke off,
    starts from what was before it and comes to the same. ``buckets`` is the same for all changes of a table.
    """
    spark = rows.sparkSession
    held = _versions(spark, folder)
    version = version if version is not None else 1 + max((v[-1] for v in held.values()), default=0)
    place = F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int")
    rows = written(rows)
    touched = sorted(r[0] for r in rows.select(place.alias("b")).distinct().collect())
    if not touched:
        return []
    before = {b: [x for x in held.get(b, []) if x < version] for b in touched}
    old = _read(spark, folder, schema, [(b, v[-1]) for b, v in before.items() if v])
    new = merge(old, rows).select(*[F.col(f.name).cast(f.dataType) for f in schema], F.lit(True).alias("__live")).withColumn("__bucket", place)
    # a row that is none keeps the version of a bucket that has lost all
    empty = spark.createDataFrame([(b,) for b in touched], "__bucket int").select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in schema], F.lit(False).alias("__live"), "__bucket")
    out = new.unionByName(empty).withColumn("__version", F.lit(version)).repartition(len(touched), "__bucket")
    out.write.partitionBy("__bucket", "__version").option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(folder)
    return touched


def upsert(rows: DataFrame, folder: str, schema: T.StructType, key: list[str], update: list[str] | None = None, order: list[F.Column] | None = None, buckets: int = BUCKETS, version: int | None = None) -> list[int]:
    """dml.upsert on the buckets that hold the rows' keys."""
    return change(rows, folder, schema, key, lambda old, new: dml.upsert(old, new, key, update, order), buckets, version)


def tidy(spark: SparkSession, folder: str, keep: int = 2) -> int:
    """Deletes all but the newest versions of each bucket; how many went."""
    gone = [(b, x) for b, v in _versions(spark, folder).items() for x in v[:-keep]]
    for b, v in gone:
        fs, at = file_system(spark, f"{folder}/__bucket={b}/__version={v}")
        fs.delete(at, True)
    return len(gone)
