"""Counters derived from the rows that they count, so that they can't diverge, and the same kept up to date by differences."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import buckets

#: Counter column of a post: the interaction that counts, and whether a user counts once.
POST_COUNTERS = {"views": ("read", True), "likes": ("liked", True), "bookmarks": ("saved", True), "shared": ("shared", False)}


def post_counters(interactions: DataFrame) -> DataFrame:
    """All counters of every post in one aggregation."""
    aggs = []
    for name, (kind, once) in POST_COUNTERS.items():
        user = F.when(F.col("interactionType") == kind, F.col("userId"))
        aggs.append((F.count_distinct(user) if once else F.count(user)).alias(name))
    return interactions.groupBy("postId").agg(*aggs)


def comment_counts(comments: DataFrame) -> DataFrame:
    return comments.groupBy("postId").agg(F.count("*").alias("comments"), F.count_if(F.col("parentId").isNull()).alias("roots"))


def follow_counts(follows: DataFrame) -> DataFrame:
    """(id, following, followers) of everyone with an edge; repeated edges count once."""
    e = follows.select("followerId", "followingId").distinct()
    sides = e.select(F.col("followerId").alias("id"), F.lit(1).alias("a"), F.lit(0).alias("b")).unionByName(e.select(F.col("followingId").alias("id"), F.lit(0).alias("a"), F.lit(1).alias("b")))
    return sides.groupBy("id").agg(F.sum("a").alias("following"), F.sum("b").alias("followers"))


def member_counts(memberships: DataFrame) -> DataFrame:
    return memberships.where("status = 'active'").groupBy("community_id").agg(F.count_distinct("user_id").alias("member_count"))


def author_counts(posts: DataFrame, stories: DataFrame) -> DataFrame:
    """(id, posts): posts, shorts and stories of everyone who has any."""
    made = posts.select(F.col("authorId").alias("id")).unionByName(stories.select(F.col("userId").alias("id")))
    return made.where("id is not null").groupBy("id").agg(F.count("*").alias("posts"))


def tag_counts(posts: DataFrame, tags: Column) -> DataFrame:
    """(tag, n): how many posts use each tag, in lower case; a post counts once however often it says it."""
    used = posts.select(F.explode(F.array_distinct(F.transform(tags, F.lower))).alias("tag"))
    return used.groupBy("tag").agg(F.count("*").alias("n"))


def added(keys: list[str], measures: list[str]) -> buckets.Merge:
    """Old sums plus new ones; a key whose sums are all 0 goes."""

    def merge(old: DataFrame, new: DataFrame) -> DataFrame:
        both = old.select(*keys, *measures).unionByName(new.select(*keys, *measures))
        return both.groupBy(*keys).agg(*[F.sum(F.coalesce(m, F.lit(0))).alias(m) for m in measures]).where(" OR ".join(f"{m} <> 0" for m in measures))

    return merge


def maintained(stream: DataFrame, deltas: Callable[[DataFrame], DataFrame], folder: str, schema: StructType, keys: list[str], checkpoint: str, in_buckets: int = buckets.BUCKETS, once: bool = False):
    """A query that keeps sums by key up to date: deltas turns a micro-batch into rows of keys and differences, which are added up and applied
    to the buckets that hold their keys. The batch's number is the version, so that a batch that comes again changes nothing."""
    measures = [f.name for f in schema if f.name not in keys]

    def apply(df: DataFrame, batch: int) -> None:
        rows = deltas(df).groupBy(*keys).agg(*[F.sum(F.coalesce(m, F.lit(0))).cast("long").alias(m) for m in measures])
        buckets.change(rows, folder, schema, keys, added(keys, measures), in_buckets, version=batch + 1)
        buckets.tidy(df.sparkSession, folder)

    q = stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    return (q.trigger(availableNow=True) if once else q).start()


#: What a post's counters are kept as, and its threads: a root comment's own count and its replies'.
POST_SUMS = "postId long, views long, likes long, bookmarks long, shared long"
THREAD_SUMS = "postId long, root long, own long, replies long"


def post_deltas(events: DataFrame, sign: Column) -> DataFrame:
    """Differences of POST_SUMS by interactions that come (sign 1) or are taken back (-1)."""
    one = lambda kind: F.when(F.col("interactionType") == kind, sign).otherwise(0).alias
    return events.where("postId IS NOT NULL").select(F.col("postId").cast("long").alias("postId"), *[one(kind)(name) for name, (kind, _) in POST_COUNTERS.items()])


def thread_deltas(events: DataFrame, sign: Column) -> DataFrame:
    """Differences of THREAD_SUMS by comments (id, parentId, postId) that come or are deleted."""
    reply = F.col("parentId").isNotNull()
    return events.where("postId IS NOT NULL").select(F.col("postId").cast("long").alias("postId"), F.coalesce("parentId", "id").cast("long").alias("root"), F.when(reply, 0).otherwise(sign).alias("own"), F.when(reply, sign).otherwise(0).alias("replies"))


def thread_counts(sums: DataFrame) -> DataFrame:
    """(postId, comments, roots) of THREAD_SUMS: a root that is gone takes its replies with it, in whatever order the events came."""
    there = F.col("own") > 0
    counts = sums.groupBy("postId").agg(F.sum(F.when(there, 1 + F.col("replies")).otherwise(0)).alias("comments"), F.count_if(there).alias("roots"))
    return counts.where("comments > 0")
