"""Closures of parent links, and the deletion of posts with all that hangs on them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import written
from . import dml

#: Doublings after which links can only run in a circle.
ROUNDS = 40


def closure(links: DataFrame, child: str = "id", parent: str = "parentId") -> DataFrame:
    """(ancestorId, descendantId, depth): every ancestor of every node, by the shortest way where there are several.

    By path doubling: after k rounds all ancestors up to 2^k levels are known, and a node takes those of the one that is 2^k levels above it; the
    rounds are the logarithm of the depth. Rows without a parent are roots and add nothing; repeated links count once. A node that
    comes to be its own ancestor is an error. Each round is written to the shared folder.
    """
    first = links.where(F.col(parent).isNotNull() & F.col(child).isNotNull()).select(F.col(parent).alias("ancestorId"), F.col(child).alias("descendantId"), F.lit(1).alias("depth"))
    known, reach = written(first.distinct()), 1
    for _ in range(ROUNDS):
        state = known.agg(F.bool_or(F.col("ancestorId") == F.col("descendantId")).alias("loop"), F.max("depth").alias("deepest")).first()
        if state["loop"]:
            raise ValueError("links run in a circle")
        if (state["deepest"] or 0) < reach:
            return known.groupBy("ancestorId", "descendantId").agg(F.min("depth").alias("depth"))
        jump = known.where(F.col("depth") == reach).select(F.col("ancestorId").alias("__via"), F.col("descendantId").alias("__node"))
        above = known.select("ancestorId", F.col("descendantId").alias("__via"), "depth").join(jump, "__via").select("ancestorId", F.col("__node").alias("descendantId"), (F.col("depth") + reach).alias("depth"))
        known, reach = written(known.unionByName(above).distinct()), 2 * reach
    raise ValueError(f"links go on after {ROUNDS} doublings")


def attached(relations: DataFrame, links: DataFrame, child: str = "id", parent: str = "parentId") -> DataFrame:
    """relations (with a row of depth 0 for each node) after new nodes came with their parents, old ones or each other: only rows of new nodes are made."""
    new = links.select(F.col(child).alias("__child"), F.col(parent).alias("__parent")).distinct()
    own = new.select(F.col("__child").alias("ancestorId"), F.col("__child").alias("descendantId"), F.lit(0).alias("depth")).distinct()
    inner = closure(new, "__child", "__parent")
    among = inner.join(own.select("ancestorId"), "ancestorId", "left_semi").select("ancestorId", "descendantId", "depth").unionByName(own)
    # what hangs on a new node whose parent is old takes all of that parent's ancestors
    tops = new.select(F.col("__child").alias("ancestorId"), "__parent")
    over = among.join(tops, "ancestorId").select("__parent", "descendantId", F.col("depth").alias("__d"))
    old = relations.select(F.col("ancestorId"), F.col("descendantId").alias("__parent"), F.col("depth").alias("__up"))
    above = over.join(old, "__parent").select("ancestorId", "descendantId", (F.col("__d") + F.col("__up") + 1).alias("depth"))
    fresh = among.unionByName(above).groupBy("ancestorId", "descendantId").agg(F.min("depth").cast("int").alias("depth"))
    return relations.select("ancestorId", "descendantId", F.col("depth").cast("int").alias("depth")).unionByName(fresh)


def delete_posts(posts: DataFrame, gone: F.Column, users: DataFrame, relations: DataFrame, by_post: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """posts without those gone; every table of by_post without rows of their postId; relations without them at either end; users with
    their count of posts less by those that went."""
    children = {name: (df, ["postId"]) for name, df in by_post.items()} | {"relations": (relations, ["ancestorId", "descendantId"])}
    out = dml.cascade(posts, gone, "id", children)
    lost = posts.where(gone).groupBy(F.col("authorId").alias("__author")).agg(F.count("*").alias("__lost"))
    left = users.join(lost, F.col("id") == F.col("__author"), "left").withColumn("posts", F.col("posts") - F.coalesce("__lost", F.lit(0))).drop("__author", "__lost")
    return out | {"posts": out.pop("parents"), "users": left}
