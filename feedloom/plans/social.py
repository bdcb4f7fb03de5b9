"""People: suggestions, follow lists, stories."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import relational as rel


def suggestions(users: DataFrame, follows: DataFrame, viewer: int, total: int = 4, seed: int = 1) -> DataFrame:
    """(id, reason, verified, mutuals): followers not followed back (at most 70 %), two hops, then a seeded fill; verified
    first, then those whom more of the viewer's followees follow."""
    mine = rel.following(follows, viewer)
    back = rel.followers(follows, viewer).join(mine, "id", "left_anti").where(F.col("id") != viewer).orderBy("id").limit(int(total * 0.7)).withColumn("src", F.lit(1))
    hop = rel.two_hop(follows, viewer).join(back, "id", "left_anti").orderBy(F.col("paths").desc(), "id").limit(total).select("id", F.lit(2).alias("src"))
    rest = users.select("id").where(F.col("id") != viewer).join(mine, "id", "left_anti").join(back, "id", "left_anti").join(hop, "id", "left_anti")
    fill = rest.orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("id").cast("string")).cast("binary")), "id").limit(total).withColumn("src", F.lit(3))
    order = Window.partitionBy(F.lit(0)).orderBy("src", "id")
    picked = back.unionByName(hop).unionByName(fill).withColumn("n", F.row_number().over(order)).where(F.col("n") <= total)
    known = follows.join(mine, follows["followerId"] == mine["id"], "left_semi").groupBy(F.col("followingId").alias("__f")).agg(F.count("*").alias("m"))
    out = picked.join(users.select(F.col("id"), "verified"), "id", "left").join(known, picked["id"] == known["__f"], "left")
    reason = F.when(F.col("src") == 1, "follows you").when(F.coalesce("m", F.lit(0)) > 0, "followed by people you follow").when(F.col("verified"), "verified").otherwise("suggested")
    last = Window.partitionBy(F.lit(0)).orderBy(F.coalesce("verified", F.lit(False)).desc(), F.coalesce("m", F.lit(0)).desc(), "id")
    return out.select(F.row_number().over(last).alias("place"), "id", reason.alias("reason"), "verified", F.coalesce("m", F.lit(0)).alias("mutuals"))


def follow_list(users: DataFrame, follows: DataFrame, viewer: int, owner: int, limit: int = 20) -> DataFrame:
    """Whom the owner follows, with mutual counts and whether the viewer follows them: mutuals first, then verified."""
    theirs = rel.following(follows, owner).withColumnRenamed("id", "__o")
    shown = users.join(theirs, F.col("id") == F.col("__o"), "left_semi")
    shown = rel.flag(shown, rel.following(follows, viewer), {"id": "id"}, "followedByMe")
    counts = rel.mutual_counts(follows, viewer).withColumnRenamed("id", "__m")
    out = shown.join(counts, F.col("id") == F.col("__m"), "left").withColumn("mutuals", F.coalesce("mutuals", F.lit(0)))
    return out.orderBy(F.col("followedByMe").desc(), F.col("verified").desc(), F.col("id").desc()).limit(limit).select("id", "username", "verified", "followedByMe", "mutuals")


def story_tray(users: DataFrame, follows: DataFrame, stories: DataFrame, views: DataFrame, viewer: int, as_of: str) -> DataFrame:
    """(id, stories, viewedAll, latest) of followees and self with stories of 24 hours: self, then unviewed, then newest."""
    now = F.lit(as_of).cast("timestamp_ntz")
    live = stories.where((F.col("createdAt") >= now - F.expr("INTERVAL 24 HOURS")) & (F.col("createdAt") <= now))
    people = rel.following(follows, viewer).unionByName(users.where(F.col("id") == viewer).select("id")).distinct()
    live = live.join(people, F.col("userId") == F.col("id"), "left_semi")
    live = rel.flag(live, views.where(F.col("userId") == viewer), {"storyId": "storyId"}, "viewed")
    tray = live.groupBy("userId").agg(F.count("*").alias("stories"), F.bool_and("viewed").alias("viewedAll"), F.max("createdAt").alias("latest"))
    by = Window.partitionBy(F.lit(0)).orderBy((F.col("userId") != viewer), "viewedAll", F.col("latest").desc(), "userId")
    return tray.select(F.row_number().over(by).alias("place"), F.col("userId").alias("id"), "stories", "viewedAll", "latest")


def user_stories(stories: DataFrame, views: DataFrame, likes: DataFrame, elements: DataFrame, follows: DataFrame, owner: int, viewer: int, as_of: str) -> DataFrame:
    """A user's stories of 24 hours, newest first: the viewer's view and like, how many others viewed each, its elements from back
    to front (absent positions are 0), and whose stories stand before and after the owner's on the viewer's ring (self, then
    followees by id; null where the owner isn't on it)."""
    now = F.lit(as_of).cast("timestamp_ntz")
    own = stories.where((F.col("userId") == owner) & (F.col("createdAt") >= now - F.expr("INTERVAL 24 HOURS")) & (F.col("createdAt") <= now))
    own = rel.flag(own, views.where(F.col("userId") == viewer), {"storyId": "storyId"}, "isViewed")
    own = rel.flag(own, likes.where(F.col("userId") == viewer), {"storyId": "storyId"}, "isLiked")
    own = rel.counted(own, views.where(F.col("userId") != owner).distinct(), "storyId", "storyId", "views")
    part = F.struct("z_index", F.col("element_type").alias("type"), F.coalesce("position_x", F.lit(0)).alias("x"), F.coalesce("position_y", F.lit(0)).alias("y"))
    nested = elements.groupBy(F.col("storyId").alias("__s")).agg(F.sort_array(F.collect_list(part)).alias("elements"))
    own = own.join(nested, F.col("storyId") == F.col("__s"), "left")
    people = rel.following(follows, viewer).where(F.col("id") != viewer).select("id", F.lit(1).alias("__later")).unionByName(follows.sparkSession.createDataFrame([(viewer, 0)], "id long, __later int"))
    near = rel.ring(people, ["__later", "id"]).where(F.col("id") == owner).withColumnRenamed("id", "__o")
    out = own.join(F.broadcast(near), F.col("userId") == F.col("__o"), "left")
    empty = F.array().cast(nested.schema["elements"].dataType)
    return out.select("storyId", "createdAt", "isViewed", "isLiked", "views", F.coalesce("elements", empty).alias("elements"), "prev_id", "next_id")
