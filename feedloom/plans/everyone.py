"""Feeds, second-degree contacts and story trays of all users in one plan each; what the functions for one viewer give, for everybody.

People whom many follow are the hot keys here: their followers are dealt into parts of a bounded size, and what is looked up for them goes to
every part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from ..operators import hops
from ..operators import ranking as rk
from ..operators import relational as rel
from ..sources.shared import written
from .feeds import with_author

#: Rows of a key that are left together.
TOGETHER = 100_000
#: Ids of followees' lists that a task holds at once, and edges of a block of viewers.
LISTS, EDGES = 1 << 23, 4_000_000


def dealt(edges: DataFrame, key: str, by: str, rows: DataFrame, together: int = TOGETHER) -> tuple[DataFrame, DataFrame]:
    """Both tables with a column ``part``: a key of more than ``together`` edges has them dealt by a hash of ``by``, and its rows once for each part.

    Joined on (key, part), no group holds a hub's edges, and the edges meet the same rows as without.
    """
    heavy = edges.groupBy(F.col(key).alias("__k")).agg(F.count("*").alias("__c")).where(F.col("__c") > together).select("__k", F.ceil(F.col("__c") / together).cast("int").alias("__parts"))
    parts = F.coalesce("__parts", F.lit(1))
    left = edges.join(heavy, F.col(key) == F.col("__k"), "left").withColumn("part", F.pmod(F.xxhash64(by), parts).cast("int")).drop("__k", "__parts")
    right = rows.join(heavy, F.col(key) == F.col("__k"), "left").withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("__k", "__parts")
    return left, right


def _edges(users: DataFrame, follows: DataFrame) -> DataFrame:
    """(viewer, author): everyone's followees and themselves."""
    own = users.select(F.col("id").alias("viewer"), F.col("id").alias("author"))
    theirs = follows.select(F.col("followerId").alias("viewer"), F.col("followingId").alias("author"))
    return own.unionByName(theirs.join(users.select(F.col("id").alias("viewer")), "viewer", "left_semi")).where("author IS NOT NULL").distinct()


def home_feeds(posts: DataFrame, users: DataFrame, follows: DataFrame, as_of: str, limit: int = 10, together: int = TOGETHER) -> DataFrame:
    """(viewer, place, id, isBackfill, score) of every user, as feeds.home_feed without priority accounts.

    Only an author's newest ``limit`` posts can be on a page. Who has fewer than that from all followees has, with them, everything that
    backfill must leave out, so that the newest 4 * limit posts of all hold the newest 3 * limit of others: that many rows, and no more, go to
    every such user.
    """
    base = posts.where("not isShort and not inCommunity").select("id", "authorId", "createdAt", "views", "likes", "comments", "shared", "bookmarks")
    newest = [F.col("createdAt").desc(), F.col("id").desc()]
    lists = rel.latest(base, ["authorId"], *newest, n=limit).select(F.col("authorId").alias("author"), "id", "createdAt")
    edges, lists = dealt(_edges(users, follows), "author", "viewer", lists, together)
    by = Window.partitionBy("viewer").orderBy(*newest)
    mine = edges.join(lists, ["author", "part"]).select("viewer", "id", "createdAt").withColumn("place", F.row_number().over(by)).where(F.col("place") <= limit)
    held = users.select(F.col("id").alias("viewer")).join(mine.groupBy("viewer").agg(F.collect_list("id").alias("own")), "viewer", "left")
    own = F.coalesce("own", F.array().cast("array<bigint>"))
    pool = with_author(base.orderBy(*newest).limit(4 * limit), users)
    pool = pool.withColumn("score", F.round(rk.backfill_score(rk.age_hours(F.col("createdAt"), as_of), F.lit(False)), 6))
    whole = pool.agg(F.array_sort(F.collect_list(F.struct(F.col("createdAt").alias("at"), F.col("id").cast("long").alias("id"), "score"))).alias("pool"))
    short = held.select("viewer", own.alias("own")).where(F.size("own") < limit).join(F.broadcast(whole), F.lit(True))
    others = F.slice(F.reverse(F.filter("pool", lambda p: ~F.array_contains("own", p["id"]))), 1, 3 * limit)
    # best score first, then the newest: an ascending sort of what is turned round
    ordered = F.reverse(F.array_sort(F.transform(others, lambda p: F.struct(p["score"].alias("score"), p["at"].alias("at"), p["id"].alias("id")))))
    fill = short.select("viewer", F.size("own").alias("n"), F.posexplode(F.slice(ordered, F.lit(1), F.lit(limit) - F.size("own"))).alias("k", "p"))
    fill = fill.select("viewer", (F.col("n") + F.col("k") + 1).alias("place"), F.col("p.id").alias("id"), F.lit(True).alias("isBackfill"), F.col("p.score").alias("score"))
    return mine.select("viewer", "place", "id", F.lit(False).alias("isBackfill"), F.lit(0.0).alias("score")).unionByName(fill)


def _numbered(e: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges with long numbers, in the order of the ids, in place of ids of any other type; and (number, id)."""
    ids = e.select(F.col("followerId").alias("id")).unionByName(e.select(F.col("followingId").alias("id"))).distinct()
    names = written(ids.repartitionByRange("id").sortWithinPartitions("id").select(F.monotonically_increasing_id().alias("number"), "id"))
    for c in ("followerId", "followingId"):
        e = e.withColumnRenamed(c, "id").join(names, "id").withColumnRenamed("number", c).drop("id")
    return e, names


def two_hops(follows: DataFrame, n: int, together: int = LISTS, edges: int = EDGES) -> DataFrame:
    """(viewer, id, paths, place): for every user the n whom most followees follow, as relational.two_hop; most paths first, then the smaller id.

    Paths are many times the edges, so they never travel: neighbouring viewers of about ``edges`` edges are a block, and what goes to it is each list that
    one of them needs, once, in as many shards of ids as hold ``together`` of them each. There paths are counted, and only n rows of a viewer leave a shard.
    """
    e, names = follows.where("followerId IS NOT NULL AND followingId IS NOT NULL").select("followerId", "followingId").distinct(), None
    if not all(isinstance(f.dataType, IntegralType) for f in e.schema):
        e, names = _numbered(e)
    # few edges can be many paths, so small partitions stay apart; written, since another sample of the ranges would be other blocks
    spread = int(follows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pairs = e.select(F.col("followerId").cast("long"), F.col("followingId").cast("long")).repartitionByRange(spread, "followerId").sortWithinPartitions("followerId", "followingId")
    lists = written(pairs.mapInArrow(hops.packed, "part int, id long, n int, ids array<long>"))
    parts, all_parts = lists.groupBy("part").agg(F.sum("n").alias("n")), Window.orderBy("part")
    total = F.sum("n").over(all_parts.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    share = F.least(F.lit(edges), F.ceil(total / (3 * follows.sparkSession.sparkContext.defaultParallelism)))
    before = F.coalesce(F.sum("n").over(all_parts.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    own = lists.join(F.broadcast(parts.select("part", F.floor(before / share).cast("int").alias("block"))), "part").select("block", "id", "ids")
    needed = own.select("block", F.explode("ids").alias("id")).distinct()
    shards = needed.join(lists.groupBy("id").agg(F.sum("n").alias("n")), "id").groupBy("block").agg(F.ceil(F.sum("n") / together).cast("int").alias("shards"))

    def dealt_out(rows: DataFrame) -> DataFrame:
        return rows.join(F.broadcast(shards), "block").withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)))

    inside = F.when(F.col("shards") == 1, F.col("ids")).otherwise(F.filter("ids", lambda x: F.pmod(F.xxhash64(x), "shards") == F.col("shard")))
    theirs = dealt_out(needed.join(lists.select("id", "ids"), "id")).select("block", "shard", F.lit(0).alias("kind"), "id", inside.alias("ids")).where(F.size("ids") > 0)
    cells = theirs.unionByName(dealt_out(own).select("block", "shard", F.lit(1).alias("kind"), "id", "ids")).repartition(spread, "block", "shard").sortWithinPartitions("block", "shard", "kind", "id")
    found = cells.mapInArrow(hops.counted(n), "viewer long, id long, paths long")
    by = Window.partitionBy("viewer").orderBy(F.col("paths").desc(), "id")
    best = found.withColumn("place", F.row_number().over(by)).where(F.col("place") <= n)
    if names is not None:
        for c in ("viewer", "id"):
            best = best.withColumnRenamed(c, "number").join(names.withColumnRenamed("id", c), "number").drop("number")
    viewer, id_ = (follows.schema[c].dataType for c in ("followerId", "followingId"))
    return best.select(F.col("viewer").cast(viewer), F.col("id").cast(id_), "paths", "place")


def story_trays(users: DataFrame, follows: DataFrame, stories: DataFrame, views: DataFrame, as_of: str, together: int = TOGETHER) -> DataFrame:
    """(viewer, place, id, stories, viewedAll, latest) of every user, as social.story_tray."""
    now = F.lit(as_of).cast("timestamp_ntz")
    live = stories.where((F.col("createdAt") >= now - F.expr("INTERVAL 24 HOURS")) & (F.col("createdAt") <= now))
    each = live.groupBy(F.col("userId").alias("author")).agg(F.count("*").alias("stories"), F.max("createdAt").alias("latest"))
    edges, each = dealt(_edges(users, follows).join(each.select("author"), "author", "left_semi"), "author", "viewer", each, together)
    seen = views.select(F.col("userId").alias("viewer"), "storyId").distinct().join(live.select("storyId", F.col("userId").alias("author")), "storyId")
    seen = seen.groupBy("viewer", "author").agg(F.count("*").alias("seen"))
    tray = edges.join(each, ["author", "part"]).join(seen, ["viewer", "author"], "left").withColumn("viewedAll", F.coalesce("seen", F.lit(0)) >= F.col("stories"))
    by = Window.partitionBy("viewer").orderBy((F.col("author") != F.col("viewer")), "viewedAll", F.col("latest").desc(), "author")
    return tray.select("viewer", F.row_number().over(by).alias("place"), F.col("author").alias("id"), "stories", "viewedAll", "latest")
