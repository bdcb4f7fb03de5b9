"""Feeds: short-form feed with tiers, home feed with backfill, tag ranking, quick picks, community posts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators import ranking as rk
from ..operators import relational as rel


def with_author(posts: DataFrame, users: DataFrame) -> DataFrame:
    """Posts with their author's verified, followers, author_posts and author_state; missing authors leave nulls."""
    a = users.select(F.col("id").alias("__a"), "verified", "followers", F.col("posts").alias("author_posts"), F.col("state").alias("author_state"))
    return posts.join(a, posts["authorId"] == a["__a"], "left").drop("__a")


def top(df: DataFrame, n: int, *order: Column) -> DataFrame:
    return df.orderBy(*order).limit(n)


def shorts_feed(posts: DataFrame, users: DataFrame, follows: DataFrame, views: DataFrame, viewer: int, interests: list[str], as_of: str, cursor: str, limit: int = 10, fresh_cap: int = 3, named: int | None = None) -> DataFrame:
    """(place, id, tier, score): a named short, fresh ones, half of the free slots followed, then discovery, then viewed filler.

    Each tier is picked by recency (then larger id) and ordered by score inside. Posts are read once: of followed,
    other and viewed ones the newest limit + fresh_cap (and the named one) go on, which hold every row that can be picked; the quotas are window sums over those few.
    """
    shorts = posts.where("isShort").where(((F.col("authorId") != viewer) & ~F.col("inCommunity")) | (F.col("id") == F.lit(named)) if named is not None else (F.col("authorId") != viewer) & ~F.col("inCommunity"))
    seen = views.where(F.col("userId") == viewer).select(F.col("postId").alias("id"))
    shorts = rel.flag(shorts, seen, {"id": "id"}, "viewed")
    shorts = rel.flag(shorts, rel.following(follows, viewer), {"authorId": "id"}, "followed")
    asked = F.col("id") == F.lit(named) if named is not None else F.lit(False)
    newest = [F.col("createdAt").desc(), F.col("id").desc()]
    few = shorts.withColumn("tier", F.when(asked, 0).when(F.col("viewed"), 4).when(F.col("followed"), 2).otherwise(3))
    few = few.withColumn("__n", F.row_number().over(Window.partitionBy("tier").orderBy(*newest))).where(F.col("__n") <= limit + fresh_cap)
    fresh = F.col("tier").isin(2, 3) & (F.col("createdAt") > F.lit(cursor).cast("timestamp_ntz"))
    few = few.withColumn("__fresh", fresh).withColumn("__n", F.row_number().over(Window.partitionBy("__fresh").orderBy(*newest)))
    pools = few.withColumn("tier", F.when(F.col("__fresh") & (F.col("__n") <= fresh_cap), 1).otherwise(F.col("tier"))).drop("__n", "__fresh")
    pools = pools.withColumn("nth", F.row_number().over(Window.partitionBy("tier").orderBy(*newest)))
    whole = Window.partitionBy(F.lit(0))
    have = {t: F.sum((F.col("tier") == t).cast("int")).over(whole) for t in (0, 1, 2, 3)}
    pools = pools.withColumns({f"n{t}": h for t, h in have.items()})
    free = F.lit(limit) - F.col("n0") - F.col("n1")
    two = F.least(F.col("n2"), F.ceil(free / 2))
    three = F.least(F.col("n3"), free - two)
    quota = F.when(F.col("tier") < 2, F.lit(limit)).when(F.col("tier") == 2, two).when(F.col("tier") == 3, three).otherwise(free - two - three)
    picked = with_author(pools.where(F.col("nth") <= quota), users)
    boost = F.when(F.col("tier") == 1, 0.2).when(F.col("tier").isin(2, 3), 0.1).otherwise(0.0)
    score = rk.shorts_score(rk.age_hours(F.col("createdAt"), as_of), F.col("category").isin(*interests), boost)
    picked = picked.withColumn("score", F.round(score, 6))
    by = Window.partitionBy(F.lit(0)).orderBy("tier", F.col("score").desc(), "id")
    return picked.select(F.row_number().over(by).alias("place"), "id", "tier", "score")


def home_feed(posts: DataFrame, users: DataFrame, follows: DataFrame, viewer: int, priority: list[int], as_of: str, limit: int = 10, exclude: list[int] | None = None) -> DataFrame:
    """(id, isBackfill, score): followees', priority accounts' and own posts, newest first; what is missing comes from
    the best of the newest 3 * limit posts of others. A page never holds more than limit."""
    base = posts.where("not isShort and not inCommunity")
    if exclude:
        base = base.where(~F.col("id").isin(*exclude))
    spark = posts.sparkSession
    mine = rel.following(follows, viewer).unionByName(spark.createDataFrame([(i,) for i in (*priority, viewer)], "id long")).distinct()
    base = rel.flag(base, mine, {"authorId": "id"}, "mine")
    newest = [F.col("createdAt").desc(), F.col("id").desc()]
    # posts are read once: the newest of either kind go on
    few = base.withColumn("__n", F.row_number().over(Window.partitionBy("mine").orderBy(*newest))).where(F.col("__n") <= 3 * limit).where(~F.col("mine") | (F.col("__n") <= limit))
    few = with_author(few, users).withColumn("isBackfill", ~F.col("mine"))
    score = rk.backfill_score(rk.age_hours(F.col("createdAt"), as_of), F.col("authorId").isin(*priority) if priority else F.lit(False))
    both = few.withColumn("score", F.when(F.col("mine"), 0.0).otherwise(F.round(score, 6)))
    order = Window.partitionBy(F.lit(0)).orderBy("isBackfill", F.col("score").desc(), *newest)
    return both.withColumn("place", F.row_number().over(order)).where(F.col("place") <= limit).select("place", "id", "isBackfill", "score")


def ranked_by_tag(posts: DataFrame, users: DataFrame, as_of: str, limit: int, cursor: tuple[float, str] | None = None) -> DataFrame:
    """(id, score, createdAt), best first, after a cursor of (score, time)."""
    df = with_author(posts, users).withColumn("score", F.round(rk.hashtag_score(rk.age_hours(F.col("createdAt"), as_of)), 6))
    if cursor is not None:
        at = F.lit(cursor[1]).cast("timestamp_ntz")
        df = df.where((F.col("score") < cursor[0]) | ((F.col("score") == cursor[0]) & (F.col("createdAt") < at)))
    return top(df, limit, F.col("score").desc(), F.col("createdAt").desc(), F.col("id")).select("id", "score", "createdAt")


def quick_picks(posts: DataFrame, views: DataFrame, viewer: int, as_of: str, limit: int = 20, days: int = 7) -> DataFrame:
    """Unviewed posts of the last days, newest first."""
    now = F.lit(as_of).cast("timestamp_ntz")
    seen = views.where(F.col("userId") == viewer).select(F.col("postId").alias("__v"))
    recent = posts.where((F.col("createdAt") >= now - F.expr(f"INTERVAL {days} DAYS")) & (F.col("createdAt") <= now) & ~F.col("isShort"))
    return top(recent.join(seen, F.col("id") == F.col("__v"), "left_anti"), limit, F.col("createdAt").desc(), F.col("id").desc()).select("id", "createdAt")


def community_page(links: DataFrame, posts: DataFrame, users: DataFrame, likes: DataFrame, saved: DataFrame, viewer: int, community: int, page: int = 1, limit: int = 20) -> DataFrame:
    """A page of a community's posts that aren't removed or short, pinned first, then newest, with the author, the viewer's
    like and save, and how many posts, pages and further rows there are."""
    shown = links.where((F.col("community_id") == community) & ~F.col("removed")).join(posts.where("not isShort"), F.col("post_id") == F.col("id"))
    total = F.broadcast(shown.agg(F.count("*").alias("total")))
    order = (F.col("pinned").desc(), F.col("date_posted").desc(), F.col("id").desc())
    shown = shown.orderBy(*order).offset((page - 1) * limit).limit(limit)
    shown = rel.flag(shown, likes.where(F.col("userId") == viewer), {"id": "postId"}, "isLiked")
    shown = rel.flag(shown, saved.where(F.col("userId") == viewer), {"id": "postId"}, "isSaved")
    a = users.select(F.col("id").alias("author_id"), "username", "verified")
    shown = shown.join(a, F.col("authorId") == F.col("author_id"), "left").join(total, F.lit(True))
    return shown.select("id", "pinned", "date_posted", "username", "verified", "isLiked", "isSaved", "total", F.ceil(F.col("total") / limit).alias("pages"), (F.col("total") > page * limit).alias("hasMore"))
