"""Changes to tables as rewrites: each takes the table and the change, and returns the new table."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def insert_ignore(target: DataFrame, rows: DataFrame, key: list[str]) -> DataFrame:
    """target and those of rows whose key it doesn't hold; of rows with one key the smallest."""
    by = Window.partitionBy(*key).orderBy(*rows.columns)
    new = rows.withColumn("__n", F.row_number().over(by)).where("__n = 1").drop("__n").join(target.select(*key), key, "left_anti")
    return target.unionByName(new.select(*target.columns))


def upsert(target: DataFrame, rows: DataFrame, key: list[str], update: list[str] | None = None, order: list[Column] | None = None) -> DataFrame:
    """rows replace target's rows of equal key, in the columns to update only (all by default).

    Of rows with one key the last by ``order`` counts (by all columns where none is given). A null in a key equals a null.
    """
    update = update if update is not None else [c for c in target.columns if c not in key]
    by = Window.partitionBy(*key).orderBy(*(order or []), *[F.col(c).desc_nulls_last() for c in sorted(rows.columns)])
    rows = rows.withColumn("__n", F.row_number().over(by)).where("__n = 1").drop("__n")
    old, new = target.withColumn("__old", F.lit(True)).alias("o"), rows.withColumn("__new", F.lit(True)).alias("n")
    on = reduce(lambda a, b: a & b, [F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in key])
    hit, has = F.col("n.__new").isNotNull(), F.col("o.__old").isNotNull()
    cols = [F.coalesce(F.col(f"o.{c}"), F.col(f"n.{c}")).alias(c) if c in key else F.when(hit & (F.lit(c in update) | ~has), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c) for c in target.columns]
    return old.join(new, on, "full_outer").select(*cols)


def update_where(target: DataFrame, predicate: Column, values: dict[str, Column]) -> DataFrame:
    return target.withColumns({c: F.when(predicate, v).otherwise(F.col(c)) for c, v in values.items()})


def delete_where(target: DataFrame, predicate: Column) -> DataFrame:
    """Rows for which the predicate isn't true; an unknown one keeps the row."""
    return target.where(~F.coalesce(predicate, F.lit(False)))


def cascade(parents: DataFrame, gone: Column, key: str, children: dict[str, tuple[DataFrame, list[str]]]) -> dict[str, DataFrame]:
    """Parents without those gone, and children without rows that refer to one by any of their columns."""
    ids = parents.where(gone).select(F.col(key).alias("__gone")).distinct()
    out = {"parents": delete_where(parents, gone)}
    for name, (df, columns) in children.items():
        for c in columns:
            df = df.join(ids, df[c] == ids["__gone"], "left_anti")
        out[name] = df
    return out


def toggled(actions: DataFrame, key: list[str]) -> DataFrame:
    """Keys that are on after every action flips them once."""
    return actions.groupBy(*key).agg(F.count("*").alias("__n")).where("__n % 2 = 1").drop("__n")


def last_action(actions: DataFrame, key: list[str], at: str, id_: str, on: Column) -> DataFrame:
    """Keys whose last action, by time and id, turns them on."""
    return actions.groupBy(*key).agg(F.max_by(F.coalesce(on, F.lit(False)), F.struct(at, id_)).alias("__on")).where("__on").drop("__on")


def renamed_columns(df: DataFrame, drop: list[str] = (), rename: dict[str, str] | None = None, add: dict[str, Column] | None = None, values: dict[str, dict[str, str]] | None = None) -> DataFrame:
    """A schema change as one rewrite: columns dropped (absent ones are passed over), values renamed, columns renamed and added."""
    df = df.drop(*drop)
    for c, table in (values or {}).items():
        new = F.col(c)
        for a, b in table.items():
            new = F.when(F.col(c) == a, F.lit(b)).otherwise(new)
        df = df.withColumn(c, new)
    df = df.withColumnsRenamed(rename or {})
    return df.withColumns({c: v for c, v in (add or {}).items() if c not in df.columns})


def transaction(tables: dict[str, DataFrame], folder: str) -> dict[str, DataFrame]:
    """All new tables or none: they are written to a new version's folder, and one small file then names the version.

    Readers follow ``current`` and so see the old tables until every new one is whole; a failure before leaves it as it was.
    The folder must be on a file system whose rename is atomic. One writer at a time.
    """
    spark = next(iter(tables.values())).sparkSession
    version = uuid.uuid4().hex
    for name, df in tables.items():
        df.write.parquet(f"{folder}/{version}/{name}")
    jvm = spark.sparkContext._jvm
    path = lambda x: jvm.org.apache.hadoop.fs.Path(f"{folder}/{x}")
    fs = path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out = fs.create(path(f"current.{version}"), True)
    out.write(bytearray(version, "ascii"))
    out.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(path("").toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(path(f"current.{version}"), path("current"), options)
    return committed(spark, folder, list(tables))


def committed(spark: SparkSession, folder: str, names: list[str]) -> dict[str, DataFrame]:
    """The tables of the last transaction in the folder."""
    version = spark.read.text(f"{folder}/current").first()[0]
    return {n: spark.read.parquet(f"{folder}/{version}/{n}") for n in names}
