"""Building blocks: flags, existence, graph hops, visibility, ordered lists, latest rows, keyset pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def flag(df: DataFrame, marks: DataFrame, on: dict[str, str], name: str) -> DataFrame:
    """Whether each row's key is among the marks (each key once, so rows are never multiplied)."""
    keys = marks.select(*[F.col(m).alias(f"__{m}") for m in on.values()]).distinct().withColumn(f"__{name}", F.lit(True))
    cond = [df[c] == keys[f"__{m}"] for c, m in on.items()]
    return df.join(keys, cond, "left").withColumn(name, F.coalesce(F.col(f"__{name}"), F.lit(False))).drop(f"__{name}", *[f"__{m}" for m in on.values()])


def counted(df: DataFrame, rows: DataFrame, key: str, other: str, name: str) -> DataFrame:
    """How many of rows belong to each row of df; none counts as 0."""
    n = rows.groupBy(F.col(other).alias("__k")).agg(F.count("*").alias("__n"))
    return df.join(n, df[key] == n["__k"], "left").withColumn(name, F.coalesce("__n", F.lit(0))).drop("__k", "__n")


def latest(df: DataFrame, keys: list[str], *order: Column, n: int = 1) -> DataFrame:
    """The first n rows of each key in the given order, which must be total."""
    by = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(by)).where(F.col("__n") <= n).drop("__n")


def following(follows: DataFrame, viewer: int) -> DataFrame:
    return follows.where(F.col("followerId") == viewer).select(F.col("followingId").alias("id")).distinct()


def followers(follows: DataFrame, viewer: int) -> DataFrame:
    return follows.where(F.col("followingId") == viewer).select(F.col("followerId").alias("id")).distinct()


def two_hop(follows: DataFrame, viewer: int) -> DataFrame:
    """(id, paths): whom the viewer's followees follow, without the viewer and those already followed."""
    mine = following(follows, viewer)
    far = follows.join(mine, follows["followerId"] == mine["id"]).groupBy(F.col("followingId").alias("hop")).agg(F.count("*").alias("paths"))
    return far.where(F.col("hop") != viewer).join(mine, far["hop"] == mine["id"], "left_anti").select(F.col("hop").alias("id"), "paths")


def mutual_counts(follows: DataFrame, viewer: int) -> DataFrame:
    """(id, mutuals): how many accounts the viewer and each other user both follow."""
    mine = following(follows, viewer)
    return follows.where(F.col("followerId") != viewer).join(mine, follows["followingId"] == mine["id"], "left_semi").groupBy(F.col("followerId").alias("id")).agg(F.count("*").alias("mutuals"))


def visible(messages: DataFrame, viewer: str) -> DataFrame:
    """Messages that the viewer has not deleted, on either side."""
    own = F.col("senderId") == viewer
    return messages.where(~F.col("deleted") & ((own & ~F.col("senderDeleted")) | (~own & ~F.col("receiverDeleted"))))


def before(df: DataFrame, time: str, id_: str, cursor: tuple | None, n: int) -> DataFrame:
    """A keyset page, newest first: the n rows after the cursor's (time, id)."""
    if cursor is not None:
        df = df.where((F.col(time) < F.lit(cursor[0])) | ((F.col(time) == F.lit(cursor[0])) & (F.col(id_) < cursor[1])))
    return df.orderBy(F.col(time).desc(), F.col(id_).desc()).limit(n)


def in_stored_order(lists: DataFrame, items: str, rows: DataFrame, key: str) -> DataFrame:
    """Rows named by stored id lists, with their place (from 1); ids without a row drop out."""
    out = lists.select("*", F.posexplode(items).alias("__pos", "__id"))
    return out.join(rows, F.col("__id") == rows[key]).withColumn("place", F.col("__pos") + 1).drop("__pos", "__id")


def ring(people: DataFrame, order: list[str], owner: list[str] | None = None) -> DataFrame:
    """Each id's previous and next on a closed ring in the given order, for each owner's list (one list if none is named)."""
    keys = [F.col(c) for c in owner or []]
    by = Window.partitionBy(*(keys or [F.lit(0)])).orderBy(*order)
    whole = by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return people.select(*keys, "id", F.coalesce(F.lag("id").over(by), F.last("id").over(whole)).alias("prev_id"), F.coalesce(F.lead("id").over(by), F.first("id").over(whole)).alias("next_id"))


def numbered_newest(df: DataFrame, time: str, id_: str, name: str) -> DataFrame:
    """Rows with their number from 1, newest first, ties to the larger id; rows without a time come last.

    Hours are counted first, and only their counts are summed in one place; rows are ordered within their hour. So no task
    orders more than an hour's rows.
    """
    hour = F.date_trunc("hour", F.col(time))
    count = df.groupBy(hour.alias("__h")).agg(F.count("*").alias("__c"))
    before = Window.orderBy(F.col("__h").desc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    count = count.withColumn("__before", F.coalesce(F.sum("__c").over(before), F.lit(0)))
    rows = df.withColumn("__hour", hour)
    rows = rows.join(count.drop("__c"), rows["__hour"].eqNullSafe(count["__h"])).drop("__h")
    inside = Window.partitionBy("__hour").orderBy(F.col(time).desc(), F.col(id_).desc())
    return rows.withColumn(name, F.col("__before") + F.row_number().over(inside)).drop("__hour", "__before")
