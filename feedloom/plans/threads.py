"""Comments and notifications."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import relational as rel


def threads(comments: DataFrame, likes: DataFrame, viewer: int, n: int = 10, before: str | None = None, skip: list[int] | None = None) -> DataFrame:
    """Each post's newest n root comments with like flag, reply count, the post's total, and whether more remain."""
    roots = comments.where("parentId is null")
    if before is not None:
        roots = roots.where(F.col("createdAt") < F.lit(before).cast("timestamp_ntz"))
    if skip:
        roots = roots.where(~F.col("id").isin(*skip))
    page = rel.latest(roots, ["postId"], F.col("createdAt").desc(), F.col("id").desc(), n=n)
    page = rel.flag(page, likes.where(F.col("userId") == viewer), {"id": "commentId"}, "isLiked")
    page = rel.counted(page, comments.where("parentId is not null"), "id", "parentId", "replies")
    page = rel.counted(page, comments, "postId", "postId", "total")
    left = roots.groupBy(F.col("postId").alias("__p")).agg(F.count("*").alias("__r"))
    page = page.join(left, page["postId"] == left["__p"])
    return page.select("postId", "id", "createdAt", "isLiked", "replies", "total", (F.col("__r") > n).alias("hasMore"))


def replies(comments: DataFrame, root: int, page: int = 1, per_page: int = 8) -> DataFrame:
    return comments.where(F.col("parentId") == root).orderBy("createdAt", "id").offset((page - 1) * per_page).limit(per_page)


def notification_page(notes: DataFrame, users: DataFrame, posts: DataFrame, viewer: int, page: int = 1, first: int = 30, later: int = 16) -> DataFrame:
    """A page (30, then 16 each) of a user's notifications, without those whose post is gone, with sender and isShort."""
    skip, n = (0, first) if page == 1 else (first + (page - 2) * later, later)
    shown = notes.where(F.col("user_id") == viewer).orderBy(F.col("createdAt").desc(), F.col("id").desc()).offset(skip).limit(n)
    s = users.select(F.col("id").alias("__s"), "username")
    p = posts.select(F.col("id").alias("__p"), "isShort")
    shown = shown.join(s, F.col("sender_id") == F.col("__s"), "left").join(p, F.col("reference_id") == F.col("__p"), "left")
    return shown.where("reference_id is null or __p is not null").select("id", "type", "username", "is_read", "createdAt", "isShort")


def dangling(notes: DataFrame, posts: DataFrame) -> DataFrame:
    """Ids of notifications whose post is gone."""
    return notes.where("reference_id is not null").join(posts.select(F.col("id").alias("__p")), F.col("reference_id") == F.col("__p"), "left_anti").select("id")
