"""Registered queries: each operator over the views of the driver's tables, with the oracle's SQL beside it."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import dates, fuzzy, names, replies, text
from ..operators import buckets, closure, counters, dml
from ..operators import relational as rel
from ..sources import events as live
from ..sources.shared import new_folder
from ..sources.tables import Tables, gazetteer, oracle, register
from ..streaming import activity, state
from . import chat, everyone, feeds, papers, social, threads

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
AS_OF, VIEWER = "2001-08-02 00:00:00", 7
NOW = "2024-01-15 08:25:00"


def query(sql: str | None = None, ctes: str = ""):
    def keep(f: Callable[[Tables], DataFrame]):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            ORACLE_SQL[f.__name__] = oracle(sql, ctes)
        return f

    return keep


def day(c: str):
    return F.to_date(F.col(c))


# ---- sources


@query("SELECT 'customer' AS name, count(*) AS n FROM customer UNION ALL SELECT 'orders', count(*) FROM orders UNION ALL SELECT 'events', count(*) FROM events")
def src2_registered_views(t):
    register(t.spark, t.sf_dir)
    return t.spark.sql("SELECT 'customer' AS name, count(*) AS n FROM customer UNION ALL SELECT 'orders', count(*) FROM orders UNION ALL SELECT 'events', count(*) FROM events")


@query("SELECT c_custkey AS id, c_name AS username FROM customer")
def src3_full_scan(t):
    return t.customer.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("username"))


@query("SELECT o_orderkey AS id, o_totalprice AS price FROM orders WHERE o_orderstatus = 'P' AND o_totalprice > 200000")
def src4_filtered_scan(t):
    return t.orders.where("o_orderstatus = 'P' AND o_totalprice > 200000").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("price"))


@query("SELECT c_custkey AS id, c_name AS username FROM customer WHERE c_custkey = 7")
def src5_primary_key_lookup(t):
    return t.customer.where(F.col("c_custkey") == 7).limit(1).select(F.col("c_custkey").alias("id"), F.col("c_name").alias("username"))


@query("SELECT o_orderkey AS id FROM orders WHERE o_custkey = 7 ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 1")
def src6_first_match(t):
    return t.orders.where(F.col("o_custkey") == 7).orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")).limit(1).select(F.col("o_orderkey").alias("id"))


@query("SELECT o_orderkey AS id, (SELECT count(*) FROM orders WHERE o_orderstatus = 'F') AS total FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 10 OFFSET 20")
def src7_page_and_total(t):
    rows = t.orders.where("o_orderstatus = 'F'")
    page = rows.orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")).offset(20).limit(10)
    return page.join(F.broadcast(rows.agg(F.count("*").alias("total"))), F.lit(True)).select(F.col("o_orderkey").alias("id"), "total")


@query("SELECT o_orderstatus AS status, count(*) AS n FROM orders GROUP BY o_orderstatus")
def src8_raw_sql(t):
    return t.spark.sql("SELECT o_orderstatus AS status, count(*) AS n FROM {orders} GROUP BY o_orderstatus", orders=t.orders)


@query("SELECT 'r_regionkey' AS name, 'int' AS kind UNION ALL SELECT 'r_name', 'string'")
def src9_describe(t):
    return t.spark.createDataFrame([(f.name, f.dataType.simpleString()) for f in t.region.schema.fields], "name string, kind string")


@query("SELECT event_type, count(*) AS n, max(event_id) AS last FROM events GROUP BY event_type")
def src10_event_source(t):
    stream = activity.event_stream(t.spark, t.sf_dir, t.events.schema, names="events.parquet")
    return activity.drained(stream, new_folder(t.spark)).groupBy("event_type").agg(F.count("*").alias("n"), F.max("event_id").alias("last"))


@query("SELECT event, problem, count(*) AS n, max(event_id) AS last FROM (SELECT *, CASE event_type WHEN 'view' THEN 'openChat' WHEN 'error' THEN 'closeChat' WHEN 'click' THEN 'userOnline' WHEN 'signup' THEN 'connection' ELSE 'dance' END AS event, CASE WHEN event_type = 'purchase' THEN 'unknown event' WHEN event_type = 'error' AND event_id % 3 = 0 THEN 'no userId' WHEN event_type = 'signup' AND event_id % 5 = 0 THEN 'data' END AS problem FROM events) GROUP BY event, problem")
def src10_events_by_kind(t):
    named = {"view": "openChat", "error": "closeChat", "click": "userOnline", "signup": "connection", "purchase": "dance"}
    kind, id_ = F.coalesce(*[F.when(F.col("event_type") == k, v) for k, v in named.items()]), F.col("event_id")
    user = F.when((kind == "closeChat") & (id_ % 3 == 0), "null").when((kind == "connection") & (id_ % 5 == 0), '"x"').otherwise(F.col("user_id").cast("string"))
    shape = '{"event":"%s","id":%d,"at":"%s","data":{"roomId":"%d","userId":%s,"socketId":"s"}}'
    lines = t.events.select(F.format_string(shape, kind, id_, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), "user_id", user).alias("value"))
    return live.read_events(lines).groupBy("event", "problem").agg(F.count("*").alias("n"), F.max("id").alias("last"))


@query(
    "SELECT lower(name) AS name, lower(n_name) AS city, r_name AS state, n_name LIKE '% %' AS variant, n_nationkey * 1000 + k AS \"at\" FROM (SELECT *, n_name AS name, 0 AS k FROM nation UNION ALL SELECT *, replace(n_name, ' ', ''), 1 FROM nation WHERE n_name LIKE '% %') JOIN region ON n_regionkey = r_regionkey"
)
def src12_gazetteer(t):
    spelt = F.when(F.contains("n_name", F.lit(" ")), F.array(F.replace("n_name", F.lit(" "), F.lit(""))))
    places = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("city"), F.col("r_name").alias("state"), spelt.alias("spellings"), F.col("n_nationkey").alias("place"))
    return gazetteer(t.spark, table=places).drop("first")


# ---- changes


@query("SELECT user_id, community_id, role, status FROM memberships UNION ALL SELECT c_custkey, (c_nationkey + 1) % 25, 'admin', 'active' FROM customer")
def snk1_insert(t):
    new = t.customer.select(F.col("c_custkey").alias("user_id"), ((F.col("c_nationkey") + 1) % 25).alias("community_id"), F.lit("admin").alias("role"), F.lit("active").alias("status"))
    return t.memberships.unionByName(new)


@query("SELECT * FROM memberships UNION ALL SELECT c_custkey, c_custkey % 25, 'member', 'active' FROM customer WHERE c_custkey % 25 <> c_nationkey")
def snk2_insert_ignore(t):
    new = t.customer.select(F.col("c_custkey").alias("user_id"), (F.col("c_custkey") % 25).cast("int").alias("community_id"), F.lit("member").alias("role"), F.lit("active").alias("status"))
    return dml.insert_ignore(t.memberships, new.unionByName(new), ["user_id", "community_id"])


@query("SELECT paperId, CAST(paperDate AS VARCHAR) AS paperDate, CASE WHEN paperDate = DATE '2024-01-15' AND isRead THEN 'failed' ELSE status END AS status, p1 FROM editions UNION ALL SELECT p_partkey, '2024-02-01', 'failed', -1 FROM part")
def snk3_upsert_columns(t):
    ed = t.editions.select("paperId", "paperDate", "status", "p1")
    new = t.editions.where("paperDate = DATE '2024-01-15' AND isRead").select(*ed.columns).withColumns({"status": F.lit("failed"), "p1": F.lit(-5).cast("long")})
    new = new.unionByName(t.part.select(F.col("p_partkey").alias("paperId"), F.lit("2024-02-01").cast("date").alias("paperDate"), F.lit("failed").alias("status"), F.lit(-1).cast("long").alias("p1")))
    folder, key = new_folder(t.spark), ["paperId", "paperDate"]
    buckets.upsert(ed, folder, ed.schema, key, buckets=16)
    buckets.upsert(new, folder, ed.schema, key, update=["status"], buckets=16)
    return buckets.table(t.spark, folder, ed.schema).withColumn("paperDate", F.col("paperDate").cast("string"))


@query("SELECT userId, postId, interactionType, max(updatedAt) AS updatedAt FROM interactions GROUP BY ALL")
def snk4_upsert_latest(t):
    i = t.interactions.select("userId", "postId", "interactionType", "updatedAt")
    old = i.where(F.dayofmonth("updatedAt") <= 15).groupBy("userId", "postId", "interactionType").agg(F.min("updatedAt").alias("updatedAt"))
    return dml.upsert(old, i, ["userId", "postId", "interactionType"], order=[F.desc("updatedAt")])


@query("SELECT DISTINCT userId, postId FROM post_views")
def snk5_find_or_create(t):
    return activity.once(t.post_views.select("userId", "postId", "updatedAt"), ["userId", "postId"], "updatedAt").select("userId", "postId")


@query("SELECT id, CASE WHEN paperDate < DATE '2024-01-10' THEN 'failed' ELSE status END AS status FROM editions")
def snk6_update_or_create(t):
    ed = t.editions.select("id", "status", "paperDate")
    return dml.upsert(ed, ed.where("paperDate < DATE '2024-01-10'").withColumn("status", F.lit("failed")), ["id"]).select("id", "status")


@query("SELECT id, isRead OR (roomId = 3 AND senderId <> 'user') AS isRead FROM messages")
def snk7_update_where(t):
    return chat.mark_read(t.messages, 3, "user").select("id", "isRead")


@query("SELECT id FROM editions WHERE NOT (paperDate < DATE '2024-01-08')")
def snk8_delete_where(t):
    return dml.delete_where(t.editions, F.col("paperDate") < F.lit("2024-01-08").cast("date")).select("id")


@query("SELECT postId, count(*) FILTER (WHERE interactionType = 'shared') AS shared, count(DISTINCT CASE WHEN interactionType = 'read' THEN userId END) AS views, count(DISTINCT CASE WHEN interactionType = 'liked' THEN userId END) AS likes, count(DISTINCT CASE WHEN interactionType = 'saved' THEN userId END) AS bookmarks FROM interactions GROUP BY postId")
def snk9_counters(t):
    return counters.post_counters(t.interactions)


@query("SELECT postId, CAST(count(*) FILTER (WHERE interactionType = 'read') AS BIGINT) AS views, CAST(count(*) FILTER (WHERE interactionType = 'liked') AS BIGINT) AS likes, CAST(count(*) FILTER (WHERE interactionType = 'saved') AS BIGINT) AS bookmarks, CAST(count(*) FILTER (WHERE interactionType = 'shared') AS BIGINT) AS shared FROM interactions GROUP BY postId HAVING count(*) FILTER (WHERE interactionType IN ('read', 'liked', 'saved', 'shared')) > 0")
def snk9_maintained(t):
    folder, posts = new_folder(t.spark), t.orders.count()
    schema = t.spark.createDataFrame([], counters.POST_SUMS).schema
    stream = activity.event_stream(t.spark, t.sf_dir, t.events.schema, names="events.parquet")
    kinds = {"view": "read", "click": "liked", "signup": "saved", "purchase": "shared"}
    kind = F.coalesce(*[F.when(F.col("event_type") == k, v) for k, v in kinds.items()])
    deltas = lambda df: counters.post_deltas(df.select((F.col("event_id") % posts).alias("postId"), kind.alias("interactionType")), F.lit(1))
    counters.maintained(stream, deltas, f"{folder}/sums", schema, ["postId"], f"{folder}/state", in_buckets=16, once=True).awaitTermination()
    return buckets.table(t.spark, f"{folder}/sums", schema)


@query("SELECT 'posts' AS name, count(*) AS n FROM posts WHERE NOT inCommunity UNION ALL SELECT 'likes', count(*) FROM post_likes WHERE postId NOT IN (SELECT id FROM posts WHERE inCommunity) UNION ALL SELECT 'saves', count(*) FROM post_saved WHERE postId NOT IN (SELECT id FROM posts WHERE inCommunity) UNION ALL SELECT 'comments', count(*) FROM comments WHERE postId NOT IN (SELECT id FROM posts WHERE inCommunity) UNION ALL SELECT 'relations', count(*) FROM post_relations WHERE ancestorId NOT IN (SELECT id FROM posts WHERE inCommunity) AND descendantId NOT IN (SELECT id FROM posts WHERE inCommunity) UNION ALL SELECT 'users', CAST(sum(posts) - (SELECT count(*) FROM posts WHERE inCommunity AND authorId IN (SELECT id FROM users)) AS BIGINT) FROM users")
def snk10_cascade(t):
    out = closure.delete_posts(t.posts, F.col("inCommunity"), t.users, t.post_relations, {"likes": t.post_likes, "saves": t.post_saved, "comments": t.comments})
    n = lambda name: (F.sum("posts") if name == "users" else F.count("*")).alias("n")
    return reduce(DataFrame.unionByName, [df.agg(n(name)).select(F.lit(name).alias("name"), "n") for name, df in out.items()])


@query("SELECT id, deleted OR (roomId = 2 AND senderId = 'user') AS deleted, senderDeleted OR roomId = 4 AS senderDeleted FROM messages")
def snk11_soft_delete(t):
    a = dml.update_where(t.messages, (F.col("roomId") == 2) & (F.col("senderId") == "user"), {"deleted": F.lit(True)})
    return dml.update_where(a, F.col("roomId") == 4, {"senderDeleted": F.lit(True)}).select("id", "deleted", "senderDeleted")


@query("SELECT id, CASE post_access_type WHEN 'everyone' THEN 'public' WHEN 'creator' THEN 'owner' ELSE 'staff' END AS access FROM communities")
def snk12_case_update(t):
    a = F.col("post_access_type")
    return t.communities.select("id", F.when(a == "everyone", "public").when(a == "creator", "owner").otherwise("staff").alias("access"))


@query("SELECT user_id, CASE WHEN role = 'moderator' THEN 'admin' ELSE role END AS role FROM memberships")
def snk13_rename_value(t):
    return dml.update_where(t.memberships, F.col("role") == "moderator", {"role": F.lit("admin")}).select("user_id", "role")


@query("SELECT id, name AS title, creator_id, CASE post_access_type WHEN 'everyone' THEN 'everyone' WHEN 'creator' THEN 'creator' ELSE 'staff' END AS post_access_type, '' AS summary FROM communities")
def snk14_schema_change(t):
    return dml.renamed_columns(t.communities, drop=["visibility", "access_type"], rename={"name": "title"}, add={"summary": F.lit("")}, values={"post_access_type": {"moderators": "staff"}})


@query("SELECT 'memberships' AS name, count(*) AS n, count(*) FILTER (WHERE role = 'moderator') AS moderators FROM memberships WHERE status <> 'banned' UNION ALL SELECT 'communities', count(*), count(*) FILTER (WHERE post_access_type = 'moderators') FROM communities")
def snk15_transaction(t):
    new = {"memberships": dml.delete_where(t.memberships, F.col("status") == "banned"), "communities": t.communities}
    held = dml.transaction(new, new_folder(t.spark))
    m = held["memberships"].agg(F.count("*").alias("n"), F.count_if(F.col("role") == "moderator").alias("moderators"))
    c = held["communities"].agg(F.count("*").alias("n"), F.count_if(F.col("post_access_type") == "moderators").alias("moderators"))
    return m.select(F.lit("memberships").alias("name"), "*").unionByName(c.select(F.lit("communities").alias("name"), "*"))


@query("SELECT m.id, m.roomId, m.senderId, s.sent FROM messages m LEFT JOIN (SELECT senderId, count(*) AS sent FROM messages WHERE NOT deleted GROUP BY senderId) s ON s.senderId = m.senderId")
def snk16_fan_out_rows(t):
    senders = t.messages.where("not deleted").groupBy("senderId").agg(F.count("*").alias("sent"))
    return activity.with_sender(t.messages, senders).select("id", "roomId", "senderId", "sent")


@query("SELECT user_id, event_type FROM events GROUP BY user_id, event_type HAVING count(*) % 2 = 1")
def snk17_toggle(t):
    return dml.toggled(t.events, ["user_id", "event_type"])


# ---- projections


@query("SELECT id, authorId, likes FROM posts")
def p1_columns(t):
    return t.posts.select("id", "authorId", "likes")


@query("SELECT DISTINCT p.id FROM posts p JOIN post_likes l ON l.postId = p.id")
def p2_empty_projection(t):
    return t.posts.join(t.post_likes, F.col("id") == F.col("postId"), "left_semi").select("id")


@query("SELECT id, shared AS shares, likes + comments + shared AS engagement FROM posts")
def p3_p4_computed_and_renamed(t):
    return t.posts.select("id", F.col("shared").alias("shares"), (F.col("likes") + F.col("comments") + F.col("shared")).alias("engagement"))


@query("SELECT c_custkey, c_name, c_mktsegment FROM customer")
def p5_dropped_columns(t):
    return t.customer.drop("c_nationkey", "c_acctbal")


@query("SELECT p.id, u.username AS name, u.verified FROM posts p JOIN users u ON u.id = p.authorId WHERE p.likes > 9")
def p6_nested_author(t):
    a = t.users.select(F.col("id").alias("a"), F.struct(F.col("username").alias("name"), "verified").alias("author"))
    return t.posts.where("likes > 9").join(a, F.col("authorId") == F.col("a")).select("id", "author.name", "author.verified")


@query("SELECT id, coalesce(nullif(comments, 0), -1) AS comments, coalesce(nullif(category, '5-LOW'), 'none') AS category FROM posts")
def p7_default_for_empty(t):
    return t.posts.select("id", F.coalesce(F.nullif("comments", F.lit(0)), F.lit(-1)).alias("comments"), F.coalesce(F.nullif("category", F.lit("5-LOW")), F.lit("none")).alias("category"))


@query("SELECT id, CASE WHEN isShort THEN 'short' WHEN inCommunity THEN 'community' ELSE 'post' END AS kind FROM posts")
def p8_conditional(t):
    return t.posts.select("id", F.when(F.col("isShort"), "short").when(F.col("inCommunity"), "community").otherwise("post").alias("kind"))


@query("SELECT c.id, c.name, m.role AS user_role FROM memberships m JOIN communities c ON c.id = m.community_id")
def p9_flattened_child(t):
    c = t.communities.select(F.struct("id", "name").alias("community"))
    return t.memberships.join(c, F.col("community_id") == F.col("community.id")).select("community.*", F.col("role").alias("user_role"))


@query("SELECT id, CASE WHEN isRead THEN CAST(paperDate AS VARCHAR) END AS readAt FROM editions")
def p10_derived_flag(t):
    return t.editions.select("id", F.when(F.col("isRead"), F.col("paperDate").cast("string")).alias("readAt"))


@query("SELECT id, p1 AS first_id, CASE WHEN p2 % 2 = 0 THEN p2 END AS first_even FROM editions")
def p11_first_of_array(t):
    ids = F.array("p1", "p2", "p3")
    return t.editions.select("id", F.try_element_at(ids, F.lit(1)).alias("first_id"), F.try_element_at(F.filter(F.array("p2"), lambda x: x % 2 == 0), F.lit(1)).alias("first_even"))


@query("SELECT id, CAST(coalesce(nullif(p1, 0), -1) AS VARCHAR) || ',' || CAST(p2 AS VARCHAR) AS ids FROM editions")
def p12_mapped_structs(t):
    items = F.transform(F.array("p1", "p2"), lambda x: F.struct(x.alias("id")))
    fixed = F.transform(F.transform(items, lambda s: s["id"]), lambda x, i: F.when((x == 0) & (i == 0), -1).otherwise(x).cast("string"))
    return t.editions.select("id", F.array_join(fixed, ",").alias("ids"))


# ---- predicates


@query("SELECT id FROM papers WHERE status = 'active' AND processingStatus = 'completed'")
def f1_equal_and(t):
    return t.papers.where((F.col("status") == "active") & (F.col("processingStatus") == "completed")).select("id")


@query("SELECT id FROM messages WHERE senderId <> 'user'")
def f2_not_equal(t):
    return t.messages.where(F.col("senderId") != "user").select("id")


@query("SELECT id FROM posts WHERE category IN ('1-URGENT', '2-HIGH') AND authorId IN (SELECT followingId FROM follows WHERE followerId = 7)")
def f3_in(t):
    return t.posts.where(F.col("category").isin("1-URGENT", "2-HIGH")).join(rel.following(t.follows, 7).withColumnRenamed("id", "f"), F.col("authorId") == F.col("f"), "left_semi").select("id")


@query("SELECT id FROM posts WHERE id NOT IN (SELECT postId FROM post_views WHERE userId = 7)")
def f4_not_in(t):
    return t.posts.join(t.post_views.where("userId = 7"), F.col("id") == F.col("postId"), "left_anti").select("id")


@query("SELECT id FROM posts WHERE likes > 3 AND likes <= 6 AND comments >= 1 AND shared < 5 AND views BETWEEN 50 AND 120")
def f5_f6_compare_between(t):
    return t.posts.where((F.col("likes") > 3) & (F.col("likes") <= 6) & (F.col("comments") >= 1) & (F.col("shared") < 5) & F.col("views").between(50, 120)).select("id")


@query("SELECT doc_id FROM documents WHERE text ILIKE '%the%and%' OR source ILIKE 'SRC1%'")
def f7_f8_like_or(t):
    return t.documents.where(F.col("text").ilike("%the%and%") | F.col("source").ilike("SRC1%")).select("doc_id")


@query("SELECT id FROM messages WHERE NOT deleted AND ((senderId = 'user' AND NOT senderDeleted) OR (senderId <> 'user' AND NOT receiverDeleted))")
def f9_visible(t):
    return rel.visible(t.messages, "user").select("id")


@query("SELECT user_id FROM memberships WHERE role IS NOT NULL AND role <> 'moderator' AND user_id NOT IN (1, 2, 3)")
def f10_and_on_one_column(t):
    return t.memberships.where(F.col("role").isNotNull() & (F.col("role") != "moderator") & ~F.col("user_id").isin(1, 2, 3)).select("user_id")


@query("SELECT id FROM comments WHERE parentId IS NULL")
def f11_is_null(t):
    return t.comments.where("parentId is null").select("id")


@query("SELECT id FROM papers WHERE status = 'active' AND deleted = false")
def f12_conditional_predicate(t):
    cond = F.lit(True)
    for c, v in {"status": "active", "processingStatus": None, "deleted": False}.items():
        cond = cond & (F.col(c) == v) if v is not None else cond
    return t.papers.where(cond).select("id")


@query("SELECT p.id FROM posts p JOIN community_posts c ON c.post_id = p.id WHERE NOT c.removed AND c.pinned")
def f13_filter_on_joined(t):
    return t.posts.join(t.community_posts.where("not removed and pinned"), F.col("id") == F.col("post_id")).select("id")


@query("SELECT id FROM editions WHERE len(list_filter([p1 % 5, p2 % 5], lambda x: x IN (1, 2))) > 0")
def f14_array_overlap(t):
    return t.editions.where(F.arrays_overlap(F.array(F.col("p1") % 5, F.col("p2") % 5), F.lit([1, 2]).cast("array<bigint>"))).select("id")


@query("SELECT id FROM (SELECT * FROM editions ORDER BY paperDate DESC, id LIMIT 50) WHERE isRead")
def f15_filter_after_limit(t):
    return t.editions.orderBy(F.desc("paperDate"), "id").limit(50).where("isRead").select("id")


@query("SELECT c_custkey FROM customer WHERE regexp_matches(c_name, '^Customer#0*[0-9]{1,3}$') AND lower(c_mktsegment) IN ('building', 'machinery')")
def f16_f17_regex_membership(t):
    return t.customer.where(F.col("c_name").rlike("^Customer#0*[0-9]{1,3}$") & F.lower("c_mktsegment").isin("building", "machinery")).select("c_custkey")


@query("SELECT id FROM posts WHERE likes < 4 OR (likes = 4 AND createdAt < TIMESTAMP '1998-01-01')")
def f18_keyset(t):
    return t.posts.where((F.col("likes") < 4) | ((F.col("likes") == 4) & (F.col("createdAt") < F.lit("1998-01-01").cast("timestamp_ntz")))).select("id")


@query(f"SELECT id FROM posts WHERE createdAt >= TIMESTAMP '{AS_OF}' - INTERVAL 7 DAYS")
def f19_rolling_window(t):
    return t.posts.where(F.col("createdAt") >= F.lit(AS_OF).cast("timestamp_ntz") - F.expr("INTERVAL 7 DAYS")).select("id")


# ---- joins


@query("SELECT l.postId, u.username FROM post_likes l JOIN posts p ON p.id = l.postId JOIN users u ON u.id = p.authorId WHERE l.userId = 7")
def j1_inner(t):
    return t.post_likes.where("userId = 7").join(t.posts, F.col("postId") == F.col("id")).drop("id").join(t.users, F.col("authorId") == F.col("id")).select("postId", "username")


@query("SELECT u.id, s.storyId FROM users u LEFT JOIN stories s ON s.userId = u.id AND s.createdAt >= TIMESTAMP '2024-01-29'")
def j2_left_filtered(t):
    s = t.stories.where(F.col("createdAt") >= F.lit("2024-01-29").cast("timestamp_ntz"))
    return t.users.join(s, F.col("id") == F.col("userId"), "left").select("id", "storyId")


@query("SELECT m.user_id, c.name, u.username AS creator FROM memberships m JOIN communities c ON c.id = m.community_id JOIN users u ON u.id = c.creator_id WHERE m.status = 'active'")
def j3_multi_level(t):
    c = t.communities.select(F.col("id").alias("cid"), "name", "creator_id")
    u = t.users.select(F.col("id").alias("uid"), F.col("username").alias("creator"))
    return t.memberships.where("status = 'active'").join(c, F.col("community_id") == F.col("cid")).join(u, F.col("creator_id") == F.col("uid")).select("user_id", "name", "creator")


@query("SELECT DISTINCT p.id, s.s_name AS tag FROM posts p JOIN lineitem ON l_orderkey = p.id JOIN supplier s ON s_suppkey = l_suppkey")
def j4_many_to_many(t):
    s = t.supplier
    return t.posts.join(t.lineitem, F.col("id") == F.col("l_orderkey")).join(s, F.col("l_suppkey") == F.col("s_suppkey")).select("id", F.col("s_name").alias("tag")).distinct()


@query("SELECT f2.followerId AS id, count(*) AS mutuals FROM follows f1 JOIN follows f2 ON f1.followingId = f2.followingId AND f2.followerId <> f1.followerId WHERE f1.followerId = 7 GROUP BY f2.followerId")
def j5_mutuals(t):
    return rel.mutual_counts(t.follows, 7)


@query("SELECT u.id, (SELECT count(*) FROM follows f WHERE f.followerId = u.id) AS following FROM users u")
def j6_correlated_count(t):
    return rel.counted(t.users.select("id"), t.follows, "id", "followerId", "following")


@query("SELECT u.id, EXISTS (SELECT 1 FROM follows f WHERE f.followerId = 7 AND f.followingId = u.id) AS followedByMe FROM users u")
def j7_exists_column(t):
    return rel.flag(t.users.select("id"), rel.following(t.follows, 7), {"id": "id"}, "followedByMe")


@query("SELECT id FROM posts WHERE authorId IN (SELECT followingId FROM follows WHERE followerId = 7)")
def j8_semi(t):
    return t.posts.join(rel.following(t.follows, 7).withColumnRenamed("id", "f"), F.col("authorId") == F.col("f"), "left_semi").select("id")


@query("SELECT p.id FROM posts p WHERE NOT EXISTS (SELECT 1 FROM interactions i WHERE i.postId = p.id)")
def j9_anti(t):
    return t.posts.select("id").join(t.interactions.select("postId"), F.col("id") == F.col("postId"), "left_anti")


@query("SELECT p.id, p.id IN (SELECT postId FROM post_likes WHERE userId = 7) AS isLiked, p.id IN (SELECT postId FROM post_saved WHERE userId = 7) AS isSaved, p.authorId IN (SELECT followingId FROM follows WHERE followerId = 7) AS isFollowing FROM posts p")
def j10_flags(t):
    df = rel.flag(t.posts.select("id", "authorId"), t.post_likes.where("userId = 7"), {"id": "postId"}, "isLiked")
    df = rel.flag(df, t.post_saved.where("userId = 7"), {"id": "postId"}, "isSaved")
    return rel.flag(df, rel.following(t.follows, 7), {"authorId": "id"}, "isFollowing").drop("authorId")


@query("SELECT m.id, q.senderId AS quotedSender, coalesce(q.deleted, false) AS quotedDeleted FROM messages m LEFT JOIN messages q ON q.id = m.replyTo")
def j11_quoted(t):
    o = t.messages.select(F.col("id").alias("qid"), F.col("senderId").alias("quotedSender"), F.col("deleted").alias("qd"))
    return t.messages.join(o, F.col("replyTo") == F.col("qid"), "left").select("id", "quotedSender", F.coalesce("qd", F.lit(False)).alias("quotedDeleted"))


@query("SELECT c.id, u.username, (SELECT count(*) FROM comments r WHERE r.parentId = c.id) AS replies FROM comments c LEFT JOIN users u ON u.id = c.authorId WHERE c.parentId IS NULL")
def j12_batched_lookups(t):
    c = t.comments.where("parentId is null")
    c = rel.counted(c, t.comments.where("parentId is not null"), "id", "parentId", "replies")
    return c.join(t.users.select(F.col("id").alias("uid"), "username"), F.col("authorId") == F.col("uid"), "left").select("id", "username", "replies")


@query("SELECT followingId AS id FROM follows WHERE followerId = 7 INTERSECT SELECT followingId FROM follows WHERE followerId = 11")
def j13_intersection(t):
    return rel.following(t.follows, 7).intersect(rel.following(t.follows, 11))


@query("SELECT f2.followingId AS id, count(*) AS paths FROM follows f1 JOIN follows f2 ON f2.followerId = f1.followingId WHERE f1.followerId = 7 AND f2.followingId <> 7 AND f2.followingId NOT IN (SELECT followingId FROM follows WHERE followerId = 7) GROUP BY f2.followingId")
def j14_two_hop(t):
    return rel.two_hop(t.follows, 7)


@query("SELECT a.followerId AS viewer, b.followingId AS id, count(*) AS paths, row_number() OVER (PARTITION BY a.followerId ORDER BY count(*) DESC, b.followingId) AS place FROM follows a JOIN follows b ON b.followerId = a.followingId WHERE b.followingId <> a.followerId AND NOT EXISTS (SELECT 1 FROM follows c WHERE c.followerId = a.followerId AND c.followingId = b.followingId) GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY a.followerId ORDER BY count(*) DESC, b.followingId) <= 4")
def j14_two_hops_of_all(t):
    return everyone.two_hops(t.follows, 4)


@query("SELECT parentId AS ancestorId, id AS descendantId, 1 AS depth FROM comments WHERE parentId IS NOT NULL")
def j15_closure_children(t):
    return t.comments.where("parentId is not null").select(F.col("parentId").alias("ancestorId"), F.col("id").alias("descendantId"), F.lit(1).alias("depth"))


@query("SELECT ancestorId, descendantId, depth FROM (WITH RECURSIVE c AS (SELECT parentId AS ancestorId, id AS descendantId, 1 AS depth FROM post_parents UNION ALL SELECT p.parentId, c.descendantId, c.depth + 1 FROM c JOIN post_parents p ON p.id = c.ancestorId) SELECT * FROM c)")
def j15_closure(t):
    return closure.closure(t.post_parents)


@query("SELECT roomId, id FROM messages QUALIFY row_number() OVER (PARTITION BY roomId ORDER BY sentAt DESC, id DESC) = 1")
def j16_w1_latest_per_group(t):
    return rel.latest(t.messages, ["roomId"], F.desc("sentAt"), F.desc("id")).select("roomId", "id")


@query("SELECT followerId, followingId AS id, coalesce(lag(followingId) OVER w, max(followingId) OVER (PARTITION BY followerId)) AS prev_id, coalesce(lead(followingId) OVER w, min(followingId) OVER (PARTITION BY followerId)) AS next_id FROM follows WINDOW w AS (PARTITION BY followerId ORDER BY followingId)")
def j17_w4_ring(t):
    return rel.ring(t.follows.withColumnRenamed("followingId", "id"), ["id"], ["followerId"])


@query("SELECT id, topic FROM papers, (SELECT DISTINCT category FROM posts) c WHERE contains(lower(c.category), topic)")
def j18_containment(t):
    # only different topics meet different categories, in one pass over those; papers come back by an equi-join
    met = names.contained(t.posts.select(F.lower("category").alias("c")).distinct(), t.papers.select("topic").distinct(), "c", "topic")
    return t.papers.join(met, F.col("topic") == F.col("name")).select("id", "topic")


@query("SELECT cp.post_id, p.authorId, c.name FROM community_posts cp LEFT JOIN posts p ON p.id = cp.post_id LEFT JOIN communities c ON c.id = cp.community_id ORDER BY cp.date_posted DESC, cp.post_id DESC LIMIT 10")
def j19_left_join_newest(t):
    return t.spark.sql("SELECT cp.post_id, p.authorId, c.name FROM {cp} cp LEFT JOIN {p} p ON p.id = cp.post_id LEFT JOIN {c} c ON c.id = cp.community_id ORDER BY cp.date_posted DESC, cp.post_id DESC LIMIT 10", cp=t.community_posts, p=t.posts, c=t.communities)


MINUTE = "((CAST(split_part(deliveryTime, ':', 1) AS INT) % 12) * 60 + CAST(substr(split_part(deliveryTime, ':', 2), 1, 2) AS INT) + CASE WHEN deliveryTime LIKE '%PM' THEN 720 ELSE 0 END)"


@query(f"SELECT id, deliveryTime FROM papers p WHERE status = 'active' AND NOT deleted AND {MINUTE} // 60 <= 13 AND NOT EXISTS (SELECT 1 FROM editions e WHERE e.paperId = p.id AND paperDate = DATE '2024-01-15')")
def j20_missing_editions(t):
    return papers.missing(t.papers, t.editions, NOW)


@query("SELECT id FROM notifications WHERE reference_id IS NOT NULL AND reference_id NOT IN (SELECT id FROM posts)")
def j21_dangling(t):
    return threads.dangling(t.notifications, t.posts)


# ---- aggregates


@query("SELECT count(*) AS unread FROM notifications WHERE user_id = 7 AND NOT is_read")
def a1_a20_unread(t):
    return t.notifications.where("user_id = 7 AND NOT is_read").agg(F.count("*").alias("unread"))


@query("SELECT count(DISTINCT followerId) AS followers, count(DISTINCT followingId) AS followed FROM follows")
def a2_count_distinct(t):
    return t.follows.agg(F.count_distinct("followerId").alias("followers"), F.count_distinct("followingId").alias("followed"))


@query("SELECT count(DISTINCT p.id) AS n FROM posts p LEFT JOIN interactions i ON i.postId = p.id WHERE p.category LIKE '%HIGH%' OR i.interactionType = 'liked'")
def a3_distinct_over_join(t):
    j = t.posts.select(F.col("id").alias("pid"), "category").join(t.interactions.select("postId", "interactionType"), F.col("pid") == F.col("postId"), "left")
    return j.where(F.col("category").like("%HIGH%") | (F.col("interactionType") == "liked")).agg(F.count_distinct("pid").alias("n"))


@query("SELECT userId, count(*) AS shorts FROM post_saved JOIN posts p ON p.id = postId WHERE isShort GROUP BY userId")
def a4_count_over_join(t):
    return t.post_saved.join(t.posts.where("isShort").select("id"), F.col("postId") == F.col("id")).groupBy("userId").agg(F.count("*").alias("shorts"))


@query("SELECT s.storyId, (SELECT count(*) FROM story_views v WHERE v.storyId = s.storyId AND v.userId <> s.userId) AS views FROM stories s")
def a5_group_count_with_zero(t):
    v = t.story_views.select(F.col("storyId").alias("vs"), F.col("userId").alias("vu"))
    n = t.stories.join(v, (F.col("storyId") == F.col("vs")) & (F.col("userId") != F.col("vu"))).groupBy(F.col("storyId").alias("k")).agg(F.count("*").alias("n"))
    return t.stories.join(n, F.col("storyId") == F.col("k"), "left").select("storyId", F.coalesce("n", F.lit(0)).alias("views"))


@query("SELECT p.id, EXISTS (SELECT 1 FROM editions e WHERE e.paperId = p.id) AS hasEdition, (SELECT count(*) FROM editions e WHERE e.paperId = p.id) AS editionCount FROM papers p")
def a6_a7_count_and_exists(t):
    return rel.counted(t.papers.select("id"), t.editions, "id", "paperId", "editionCount").withColumn("hasEdition", F.col("editionCount") > 0)


@query("SELECT userId, max(createdAt) AS latest, bool_and(createdAt > TIMESTAMP '2024-01-03') AS every_, bool_or(createdAt > TIMESTAMP '2024-01-29') AS some_ FROM stories GROUP BY userId")
def a8_a9_a10_max_every_some(t):
    at = F.col("createdAt")
    ts = lambda s: F.lit(s).cast("timestamp_ntz")
    return t.stories.groupBy("userId").agg(F.max(at).alias("latest"), F.bool_and(at > ts("2024-01-03")).alias("every_"), F.bool_or(at > ts("2024-01-29")).alias("some_"))


@query("SELECT category, max(likes) AS top, min(likes) AS low, round(avg(likes), 6) AS mean, CAST(sum(views) AS BIGINT) AS views FROM posts GROUP BY category")
def a11_a12_stats(t):
    return t.posts.groupBy("category").agg(F.max("likes").alias("top"), F.min("likes").alias("low"), F.round(F.avg("likes"), 6).alias("mean"), F.sum("views").alias("views"))


@query("SELECT word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '([a-z0-9]+)', 1)) AS word FROM documents) WHERE length(word) > 9 GROUP BY word HAVING count(*) > 2")
def a13_frequency(t):
    w = t.documents.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("([a-z0-9]+)"), F.lit(1))).alias("word"))
    return w.where(F.length("word") > 9).groupBy("word").agg(F.count("*").alias("n")).where("n > 2")


@query("SELECT userId, interactionType, string_agg(CAST(postId AS VARCHAR), ',' ORDER BY postId) AS posts FROM (SELECT DISTINCT userId, interactionType, postId FROM interactions) GROUP BY ALL")
def a14_a15_grouped_lists(t):
    ids = F.array_sort(F.collect_set("postId"))
    return t.interactions.groupBy("userId", "interactionType").agg(F.array_join(F.transform(ids, lambda x: x.cast("string")), ",").alias("posts"))


@query("SELECT userId, count(*) FILTER (WHERE interactionType = 'read') AS reads, count(*) FILTER (WHERE interactionType = 'liked') AS likes, count(*) AS n FROM interactions GROUP BY userId")
def a16_conditional_counts(t):
    k = F.col("interactionType")
    return t.interactions.groupBy("userId").agg(F.count_if(k == "read").alias("reads"), F.count_if(k == "liked").alias("likes"), F.count("*").alias("n"))


@query("SELECT paperId, CAST(sum(len([p1, p2, p3])) AS BIGINT) AS posts FROM editions GROUP BY paperId")
def a17_array_length(t):
    return t.editions.groupBy("paperId").agg(F.sum(F.coalesce(F.size(F.array("p1", "p2", "p3")), F.lit(0))).alias("posts"))


@query("SELECT authorId, count(*) AS total, CAST(ceil(count(*) / 10.0) AS BIGINT) AS pages, count(*) > 10 AS hasMore FROM posts GROUP BY authorId")
def a18_a19_page_math(t):
    n = F.count("*")
    return t.posts.groupBy("authorId").agg(n.alias("total"), F.ceil(n / 10).alias("pages"), (n > 10).alias("hasMore"))


@query("SELECT CASE WHEN d <= 0 THEN 'today' WHEN d = 1 THEN 'yesterday' WHEN d < 7 THEN 'week' WHEN d < 30 THEN 'month' ELSE 'earlier' END AS bucket, count(*) AS n FROM (SELECT date_diff('day', CAST(createdAt AS DATE), DATE '2024-01-31') AS d FROM notifications) GROUP BY 1")
def a21_date_buckets(t):
    return t.notifications.groupBy(dates.bucket(F.col("createdAt"), F.lit("2024-01-31").cast("timestamp_ntz")).alias("bucket")).agg(F.count("*").alias("n"))


CAN = "CASE post_access_type WHEN 'everyone' THEN true WHEN 'moderators' THEN creator_id = user_id OR role IN ('admin', 'moderator') WHEN 'creator' THEN creator_id = user_id OR role = 'admin' ELSE false END"


@query(f"SELECT user_id, community_id FROM memberships JOIN communities c ON c.id = community_id WHERE {CAN} AND status = 'active'")
def a22_udf7_postable(t):
    m = t.memberships.where("status = 'active'").join(t.communities, F.col("community_id") == F.col("id"))
    return m.where(text.can_post(F.col("role"), F.col("creator_id") == F.col("user_id"), F.col("post_access_type"))).select("user_id", "community_id")


@query("SELECT postId, id FROM comments WHERE parentId IS NULL QUALIFY row_number() OVER (PARTITION BY postId ORDER BY createdAt DESC, id DESC) <= 3")
def a23_merged_pages(t):
    """Each post's first page of two and its next page of two, which overlap by one when a comment came in between."""
    roots, newest = t.comments.where("parentId is null"), (F.desc("createdAt"), F.desc("id"))
    ranked = roots.withColumn("n", F.row_number().over(Window.partitionBy("postId").orderBy(*newest)))
    old, new = ranked.where("n <= 2"), ranked.where("n between 2 and 3")
    fresh = new.join(old.select(F.col("id").alias("__o")), F.col("id") == F.col("__o"), "left_anti")
    return old.unionByName(fresh).select("postId", "id")


# ---- windows


@query("SELECT event_id, coalesce(CAST(ts AS DATE) <> lag(CAST(ts AS DATE)) OVER (PARTITION BY user_id ORDER BY ts, event_id), true) AS newDay FROM events")
def w2_day_separator(t):
    by = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return t.events.select("event_id", F.coalesce(day("ts") != F.lag(day("ts")).over(by), F.lit(True)).alias("newDay"))


@query("SELECT postId, min(id) AS firstId FROM interactions GROUP BY postId")
def w3_first_wins(t):
    return rel.latest(t.interactions, ["postId"], F.asc("id")).select("postId", F.col("id").alias("firstId"))


@query("SELECT authorId, id FROM posts QUALIFY row_number() OVER (PARTITION BY authorId ORDER BY likes DESC, id) <= 3")
def w6_top_k_per_group(t):
    return rel.latest(t.posts, ["authorId"], F.desc("likes"), F.asc("id"), n=3).select("authorId", "id")


ACTIVITY = """m AS (SELECT roomId, max(sentAt) AS mat, arg_max(id, sentAt) AS mid, arg_max(isRead, sentAt) AS mread FROM messages GROUP BY roomId), r AS (SELECT roomId, max(sentAt) AS rat, arg_max(id, sentAt) AS rid FROM reactions GROUP BY roomId), u AS (SELECT roomId, max(sentAt) AS uat, arg_max(id, sentAt) AS uid FROM reactions WHERE NOT isRead GROUP BY roomId),
la AS (SELECT m.roomId, CASE WHEN NOT mread THEN 'message' WHEN uat IS NOT NULL THEN 'reaction' WHEN rat > mat THEN 'reaction' ELSE 'message' END AS kind, CASE WHEN NOT mread THEN mid WHEN uat IS NOT NULL THEN uid WHEN rat > mat THEN rid ELSE mid END AS id, CASE WHEN NOT mread THEN mat WHEN uat IS NOT NULL THEN uat WHEN rat > mat THEN rat ELSE mat END AS sentAt FROM m LEFT JOIN r USING (roomId) LEFT JOIN u USING (roomId))"""


@query("SELECT roomId, kind, id, sentAt FROM la", ACTIVITY)
def w7_q12_last_activity(t):
    return chat.last_activity(t.messages, t.reactions)


# ---- order and pages


@query("SELECT id FROM posts ORDER BY likes DESC, createdAt DESC, id LIMIT 25 OFFSET 10")
def o1_o6_order_limit_offset(t):
    return t.posts.orderBy(F.desc("likes"), F.desc("createdAt"), "id").offset(10).limit(25).select("id")


@query("SELECT c.id, count(m.user_id) AS members FROM communities c LEFT JOIN memberships m ON m.community_id = c.id GROUP BY c.id ORDER BY members DESC, c.id LIMIT 5")
def o2_order_chosen_at_run_time(t):
    orders = {"newest": [F.desc("id")], "name": [F.asc("name")], "members": [F.desc("members"), F.asc("id")]}
    return rel.counted(t.communities, t.memberships, "id", "community_id", "members").orderBy(*orders["members"]).limit(5).select("id", "members")


@query("SELECT id FROM users ORDER BY CASE WHEN id IN (SELECT followingId FROM follows WHERE followerId = 7) THEN 1 ELSE 0 END DESC, verified DESC, id LIMIT 30")
def o3_case_order(t):
    return rel.flag(t.users, rel.following(t.follows, 7), {"id": "id"}, "m").orderBy(F.desc("m"), F.desc("verified"), "id").limit(30).select("id")


@query("SELECT e.id AS edition, u.pos AS place, p.id FROM editions e, (SELECT unnest([1, 2, 3]) AS pos) u JOIN posts p ON p.id = CASE u.pos WHEN 1 THEN e.p1 WHEN 2 THEN e.p2 ELSE e.p3 END")
def o4_stored_order(t):
    e = t.editions.select(F.col("id").alias("edition"), F.array("p1", "p2", "p3").alias("ids"))
    return rel.in_stored_order(e, "ids", t.posts.select("id"), "id").select("edition", "place", "id")


@query("SELECT id FROM users ORDER BY md5('3:' || CAST(id AS VARCHAR)), id LIMIT 20")
def o5_seeded_shuffle(t):
    return t.users.orderBy(F.md5(F.concat(F.lit("3:"), F.col("id").cast("string")).cast("binary")), "id").limit(20).select("id")


@query("SELECT id FROM notifications WHERE user_id = 21 ORDER BY createdAt DESC, id DESC LIMIT 16 OFFSET 30")
def o7_uneven_pages(t):
    page, first, later = 2, 30, 16
    return t.notifications.where("user_id = 21").orderBy(F.desc("createdAt"), F.desc("id")).offset(first + (page - 2) * later).limit(later).select("id")


@query("SELECT id FROM posts WHERE createdAt < TIMESTAMP '1999-01-01' ORDER BY createdAt DESC, id DESC LIMIT 15")
def o8_keyset(t):
    return rel.before(t.posts.where(F.col("createdAt") < F.lit("1999-01-01").cast("timestamp_ntz")), "createdAt", "id", None, 15).select("id")


@query("SELECT id FROM posts WHERE id NOT IN (1, 5, 9, 40) ORDER BY createdAt DESC, id DESC LIMIT 15")
def o10_skip_list(t):
    skip = t.spark.createDataFrame([(1,), (5,), (9,), (40,)], "s long")
    return rel.before(t.posts.join(F.broadcast(skip), F.col("id") == F.col("s"), "left_anti"), "createdAt", "id", None, 15).select("id")


@query("SELECT id FROM (SELECT * FROM posts ORDER BY createdAt DESC, id DESC LIMIT 60) ORDER BY likes DESC, id LIMIT 20")
def o11_nested_top_k(t):
    return t.posts.orderBy(F.desc("createdAt"), F.desc("id")).limit(60).orderBy(F.desc("likes"), "id").limit(20).select("id")


@query(f"SELECT paperId, id, row_number() OVER (PARTITION BY paperId ORDER BY isRead, CAST(paperDate AS TIMESTAMP) + to_minutes({MINUTE}) DESC, id) AS place, isRead FROM editions WHERE paperDate <= DATE '2024-01-31'")
def o13_unread_then_time(t):
    return papers.reading_list(t.editions, "2024-01-31")


@query("SELECT id, verified, followers FROM users ORDER BY verified DESC, followers DESC, id LIMIT 25")
def o14_verified_then_count(t):
    return t.users.orderBy(F.desc("verified"), F.desc("followers"), "id").limit(25).select("id", "verified", "followers")


@query("SELECT DISTINCT CAST(CAST(ts AS DATE) AS VARCHAR) AS day FROM events ORDER BY day")
def o16_sorted_keys(t):
    return t.events.select(day("ts").cast("string").alias("day")).distinct().orderBy("day")


@query("SELECT c_custkey FROM customer ORDER BY c_custkey LIMIT 30")
def o17_capped(t):
    return t.customer.select("c_custkey").orderBy("c_custkey").limit(30)


@query("SELECT doc_id, CASE WHEN length(text) > 110 THEN substr(text, 1, 110) || '...' ELSE text END AS preview FROM documents")
def o18_ellipsis(t):
    return t.documents.select("doc_id", text.ellipsis(F.col("text")).alias("preview"))


# ---- set operations


@query("SELECT 1 AS tier, postId FROM post_saved WHERE userId = 7 UNION ALL SELECT 2, postId FROM post_likes WHERE userId = 7")
def u1_ordered_concat(t):
    a = t.post_saved.where("userId = 7").select(F.lit(1).alias("tier"), "postId")
    return a.unionByName(t.post_likes.where("userId = 7").select(F.lit(2).alias("tier"), "postId"))


@query("SELECT postId FROM post_saved UNION SELECT postId FROM post_likes")
def u2_distinct_union(t):
    return t.post_saved.select("postId").union(t.post_likes.select("postId")).distinct()


@query("SELECT userId FROM post_saved INTERSECT SELECT userId FROM post_likes")
def u3_intersection(t):
    return t.post_saved.select("userId").intersect(t.post_likes.select("userId"))


@query("SELECT userId, postId FROM post_views EXCEPT SELECT userId, postId FROM post_likes")
def u4_difference(t):
    return t.post_views.select("userId", "postId").subtract(t.post_likes.select("userId", "postId"))


# ---- scalars and text


@query("SELECT doc_id, lower(trim(source)) || '-' || substr(lang, 1, 1) AS s, replace(source, 'src', 'S') AS r, starts_with(source, 'src1') AS p, lpad(CAST(doc_id AS VARCHAR), 6, '0') AS padded, split_part(source, 'c', 2) AS part FROM documents")
def fn_string(t):
    s = F.col("source")
    return t.documents.select("doc_id", F.concat(F.lower(F.trim(s)), F.lit("-"), F.substring("lang", 1, 1)).alias("s"), F.replace(s, F.lit("src"), F.lit("S")).alias("r"), s.startswith("src1").alias("p"), F.lpad(F.col("doc_id").cast("string"), 6, "0").alias("padded"), F.split_part(s, F.lit("c"), F.lit(2)).alias("part"))


@query("SELECT doc_id, list_aggregate(regexp_extract_all(text, '#([a-zA-Z0-9_]+)', 1), 'string_agg', ',') AS tags, len(regexp_extract_all(text, '@([a-zA-Z0-9_]+)', 1)) AS mentions FROM (SELECT doc_id, '#' || source || ' ' || text || ' @x #y' AS text FROM documents)")
def fn_tags_mentions(t):
    x = F.concat(F.lit("#"), "source", F.lit(" "), "text", F.lit(" @x #y"))
    return t.documents.select("doc_id", F.array_join(text.tags(x), ",").alias("tags"), F.size(text.mentions(x)).alias("mentions"))


@query("SELECT c_custkey, round(exp(-0.05 * c_nationkey), 6) AS e, round(ln(c_custkey + 1), 6) AS l, CAST(ceil(c_acctbal) AS BIGINT) AS c, CAST(floor(c_acctbal) AS BIGINT) AS f, least(c_nationkey, 5) AS lo, greatest(c_nationkey, 5) AS hi FROM customer")
def fn_math(t):
    k = F.col("c_nationkey")
    return t.customer.select("c_custkey", F.round(F.exp(-0.05 * k), 6).alias("e"), F.round(F.log(F.col("c_custkey") + 1), 6).alias("l"), F.ceil("c_acctbal").alias("c"), F.floor("c_acctbal").alias("f"), F.least(k, F.lit(5)).alias("lo"), F.greatest(k, F.lit(5)).alias("hi"))


@query("SELECT event_id, strftime(ts + INTERVAL 330 MINUTES, '%Y-%m-%d %H:%M') AS local_time, CAST(CAST(ts + INTERVAL 330 MINUTES AS DATE) AS VARCHAR) AS local_day, hour(ts) AS h, minute(ts) AS m FROM events")
def fn_date_udf8(t):
    at = F.col("ts")
    return t.events.select("event_id", F.date_format(dates.local(at), "yyyy-MM-dd HH:mm").alias("local_time"), dates.local_date(at).cast("string").alias("local_day"), F.hour(at).alias("h"), F.minute(at).alias("m"))


@query(f"SELECT id, {MINUTE} AS minute, CASE WHEN CAST(DATE '2024-01-15' AS TIMESTAMP) + to_minutes({MINUTE}) > TIMESTAMP '2024-01-15 13:55:00' THEN CAST(DATE '2024-01-15' AS TIMESTAMP) + to_minutes({MINUTE}) ELSE CAST(DATE '2024-01-16' AS TIMESTAMP) + to_minutes({MINUTE}) END AS next_at FROM papers")
def fn_delivery_time(t):
    now = dates.local(F.lit(NOW).cast("timestamp_ntz"))
    return t.papers.select("id", dates.delivery_minute(F.col("deliveryTime")).alias("minute"), dates.next_delivery(F.col("deliveryTime"), now).alias("next_at"))


@query("SELECT id, CASE WHEN s < 60 THEN 'just now' WHEN s < 3600 THEN (s // 60) || 'm ago' WHEN s < 86400 THEN (s // 3600) || 'h ago' WHEN s < 604800 THEN (s // 86400) || 'd' ELSE strftime(createdAt, '%Y-%m-%d') END AS ago FROM (SELECT id, createdAt, date_diff('microsecond', createdAt, TIMESTAMP '2024-01-31') // 1000000 AS s FROM notifications)")
def fn_relative_time(t):
    return t.notifications.select("id", dates.ago(F.col("createdAt"), F.lit("2024-01-31").cast("timestamp_ntz")).alias("ago"))


@query("SELECT id, list_contains([p1, p2, p3], p1) AS has, list_position([p1, p2, p3], p3) AS pos, len(list_distinct([p1, p2, p3])) AS kinds, [p1, p2, p3][2] AS second, CAST(list_sum([p1, p2, p3]) AS BIGINT) AS total FROM editions")
def fn_array(t):
    a = F.array("p1", "p2", "p3")
    return t.editions.select("id", F.array_contains(a, F.col("p1")).alias("has"), F.array_position(a, F.col("p3")).alias("pos"), F.size(F.array_distinct(a)).alias("kinds"), a[1].alias("second"), F.aggregate(a, F.lit(0).cast("long"), lambda x, y: x + y).alias("total"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, coalesce(json_extract_string(props, '$.missing'), 'none') AS other, CAST(len(json_keys(props)) AS INT) + 1 AS entries, event_type || '=' || json_extract_string(props, '$.k') AS entry FROM events")
def fn_json_map(t):
    p = F.from_json("props", "k long, missing string")
    held = F.map_concat(F.from_json("props", "map<string,string>"), F.create_map(F.concat(F.lit("type:"), "event_type"), F.lit("1")))
    entry = F.concat_ws("=", "event_type", F.try_element_at(held, F.lit("k")))
    return t.events.select("event_id", p["k"].alias("k"), F.coalesce(p["missing"], F.lit("none")).alias("other"), F.size(held).alias("entries"), entry.alias("entry"))


@query("SELECT event_id, substr(md5('id:5:' || event_id), 1, 16) AS token FROM events")
def fn_random_ids(t):
    return t.events.select("event_id", text.seeded_id(F.col("event_id"), 5).alias("token"))


@query("SELECT id, CASE WHEN v > 999 THEN format('{:.1f}', v / 1000.0) || 'k' ELSE CAST(v AS VARCHAR) END AS shown FROM (SELECT id, views * 10 + 5 AS v FROM posts)")
def fn_compact_number(t):
    return t.posts.select("id", text.compact(F.col("views") * 10 + 5).alias("shown"))


@query("SELECT followerId, followingId, CASE WHEN CAST(followerId AS VARCHAR) < CAST(followingId AS VARCHAR) THEN followerId || '_' || followingId ELSE followingId || '_' || followerId END AS room FROM follows")
def fn_room_key(t):
    return t.follows.select("followerId", "followingId", text.room_key(F.col("followerId").cast("string"), F.col("followingId").cast("string")).alias("room"))


@query("SELECT DISTINCT p_partkey FROM (SELECT p_partkey, lower(p_name) AS a, unnest(range(1, greatest(length(p_name) - 4, 1) + 1)) AS i FROM part) WHERE contains(a, 'widgt') OR levenshtein(substr(a, i, 5), 'widgt') <= 0.3 * 5")
def udf5_fuzzy(t):
    return t.part.where(text.similar(F.col("p_name"), F.lit("widgt"))).select("p_partkey")


WORDS = "w AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]{4,}')) AS word FROM benchmark)"


@query(
    "SELECT term, name, CAST(min(levenshtein(term, part)) AS INT) AS edits FROM (SELECT t.word AS term, n.word AS name, substr(n.word, i, len) AS part FROM w t JOIN w n ON length(n.word) >= length(t.word) - k(t.word), LATERAL (SELECT unnest(range(1, length(n.word) + 1)) AS i), LATERAL (SELECT unnest(range(greatest(length(t.word) - k(t.word), 0), length(t.word) + k(t.word) + 1)) AS len)) WHERE levenshtein(term, part) <= floor(0.3 * length(term)) GROUP BY term, name".replace("k(t.word)", "CAST(floor(0.3 * length(t.word)) AS BIGINT)"),
    WORDS,
)
def udf5_fuzzy_terms(t):
    words = t.benchmark.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{4,}"), F.lit(0))).alias("word")).distinct()
    return fuzzy.fuzzy_matches(words, words, "word", "word")


@query("SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 'media/images/' WHEN p_size % 3 = 1 THEN 'media/videos/' ELSE 'media/files/' END || p_name AS url FROM part")
def udf6_media_url(t):
    kind = F.when(F.col("p_size") % 3 == 0, "image").when(F.col("p_size") % 3 == 1, "video").otherwise("pdf")
    return t.part.select("p_partkey", text.media_url("media", F.col("p_name"), kind).alias("url"))


#: The tables' prose is invented, and so are the places it is searched for: a place, its state, other spellings.
PLACES = (("thershtion", "North", ("ertion",)), ("onment", "South", ()), ("oiment", "West", ("la elle",)), ("on the it", "East", ()), ("eauou", "West", ()), ("hested", "North", ("shanst",)))
_PLACE_ROWS = ", ".join(f"('{n}', '{c}', '{s}', {str(bool(o)).lower()}, {1000 * k + j})" for k, (c, s, o) in enumerate(PLACES) for j, n in enumerate((c, *o)))


@query(
    "SELECT doc_id, arg_min(city, r) AS city, arg_min(state, r) AS state FROM (SELECT d.doc_id, f.city, f.state, f.r FROM d LEFT JOIN f ON f.doc_id = d.doc_id) GROUP BY doc_id",
    rf"""g AS (SELECT * FROM (VALUES {_PLACE_ROWS}) g(name, city, state, variant, place)), d AS (SELECT doc_id, lower(coalesce(text, '')) AS t, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\s,.!?;:(){{}}''"\[\]-]+'), lambda w: w <> '') AS w FROM documents),
k AS (SELECT doc_id, ' ' || array_to_string(w, ' ') || ' ' AS s FROM d),
f AS (SELECT doc_id, city, state, (0, len(string_split(name, ' ')), instr(s, ' ' || name || ' '), place) AS r FROM k JOIN g ON contains(s, ' ' || name || ' ') AND length(name) >= 3 UNION ALL SELECT doc_id, city, state, (CASE WHEN variant THEN 1 ELSE 2 END, 0, 0, place) FROM d JOIN g ON contains(t, name) AND (variant OR length(name) >= 5))""",
)
def udf1_city(t):
    return names.detect_city(t.documents, gazetteer(t.spark, PLACES), "doc_id", "text")


@query("SELECT id, CASE postCount % 4 WHEN 0 THEN concat_ws(',', topic, second, language, intent, focus) WHEN 1 THEN topic ELSE 'General' END AS categories FROM papers")
def src13_udf3_categories(t):
    return t.papers.select("id", F.array_join(replies.categories(F.col("categoriesReply")), ",").alias("categories"))


@query("SELECT id, topic || ',specified' AS primary_topics, second AS secondary_topics, stateNamed AS states, coalesce(excluded, '') AS excluded, language, audience, intent AS intent_type, focus AS focus_level FROM papers")
def src13_udf4_metadata(t):
    m = t.papers.select("id", replies.metadata(F.col("reply")).alias("m"))
    lists = [F.array_join(F.col(f"m.{c}"), ",").alias(n) for c, n in (("primary_topics", "primary_topics"), ("secondary_topics", "secondary_topics"), ("regions.states", "states"), ("excluded_topics", "excluded"))]
    return m.select("id", *lists, "m.language", "m.audience", "m.intent_type", "m.focus_level")


# ---- composites

AGE = f"(date_diff('second', createdAt, TIMESTAMP '{AS_OF}') / 3600.0)"
ENG = "(0.10 * views + 0.15 * likes + 0.25 * comments + 0.25 * shared + 0.25 * bookmarks)"
CRED = "(0.5 * CAST(coalesce(verified, false) AS INT) + 0.4 * coalesce(followers, 0) / (coalesce(followers, 0) + 100.0) + 0.1 * coalesce(author_posts, 0) / (coalesce(author_posts, 0) + 50.0))"
AUTHORED = "ap AS (SELECT p.*, u.verified, u.followers, u.posts AS author_posts, u.state AS author_state FROM posts p LEFT JOIN users u ON u.id = p.authorId)"


@query(
    "SELECT row_number() OVER (ORDER BY tier, score DESC, id) AS place, id, tier, score FROM scored",
    AUTHORED
    + f""", named AS (SELECT max(o_orderkey) AS id FROM (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P' AND o_custkey <> {VIEWER})),
s0 AS (SELECT *, id IN (SELECT postId FROM post_views WHERE userId = {VIEWER}) AS viewed, authorId IN (SELECT followingId FROM follows WHERE followerId = {VIEWER}) AS followed FROM ap WHERE isShort AND ((NOT inCommunity AND authorId <> {VIEWER}) OR id = (SELECT id FROM named))),
s AS (SELECT * FROM s0 WHERE id <> (SELECT id FROM named)),
fresh AS (SELECT * FROM s WHERE NOT viewed AND createdAt > TIMESTAMP '2001-07-20' ORDER BY createdAt DESC, id DESC LIMIT 3),
rest AS (SELECT *, CASE WHEN viewed THEN 4 WHEN followed THEN 2 ELSE 3 END AS tier FROM s WHERE id NOT IN (SELECT id FROM fresh)),
pool AS (SELECT *, 1 AS tier FROM fresh UNION ALL SELECT * FROM rest UNION ALL SELECT *, 0 FROM s0 WHERE id = (SELECT id FROM named)),
nth AS (SELECT *, row_number() OVER (PARTITION BY tier ORDER BY createdAt DESC, id DESC) AS nth FROM pool),
c AS (SELECT count(*) FILTER (WHERE tier < 2) AS n1, least(10, count(*) FILTER (WHERE tier = 2)) AS n2, least(10, count(*) FILTER (WHERE tier = 3)) AS n3 FROM pool),
q AS (SELECT n1, least(n2, CAST(ceil((10 - n1) / 2.0) AS BIGINT)) AS two, n3 FROM c), q2 AS (SELECT n1, two, least(n3, 10 - n1 - two) AS three FROM q),
picked AS (SELECT nth.* FROM nth, q2 WHERE nth <= CASE tier WHEN 0 THEN 1 WHEN 1 THEN n1 WHEN 2 THEN two WHEN 3 THEN three ELSE 10 - n1 - two - three END),
scored AS (SELECT id, tier, round(0.4 * exp(-0.05 * {AGE}) + 0.4 * ln({ENG} + 1) / 10 + 0.1 * {CRED} + 0.05 * CAST(category IN ('1-URGENT', '3-MEDIUM') AS INT) + CASE tier WHEN 1 THEN 0.2 WHEN 2 THEN 0.1 WHEN 3 THEN 0.1 ELSE 0.0 END, 6) AS score FROM picked)""",
)
def q1_w5_shorts_feed(t):
    named = t.orders.where((F.col("o_orderstatus") == "P") & (F.col("o_custkey") != VIEWER)).agg(F.max("o_orderkey")).first()[0]
    return feeds.shorts_feed(t.posts, t.users, t.follows, t.post_views, VIEWER, ["1-URGENT", "3-MEDIUM"], AS_OF, "2001-07-20 00:00:00", named=named)


@query(
    "SELECT place, id, isBackfill, score FROM (SELECT *, row_number() OVER (ORDER BY isBackfill, score DESC, createdAt DESC, id DESC) AS place FROM both_) WHERE place <= 30",
    AUTHORED
    + f""", b AS (SELECT *, authorId IN (SELECT followingId FROM follows WHERE followerId = 1400 UNION ALL SELECT * FROM (VALUES (1), (2), (1400)) v(x)) AS mine FROM ap WHERE NOT isShort AND NOT inCommunity AND id NOT IN (3, 4)),
main AS (SELECT id, createdAt, false AS isBackfill, 0.0 AS score FROM b WHERE mine ORDER BY createdAt DESC, id DESC LIMIT 30),
pool AS (SELECT * FROM b WHERE NOT mine ORDER BY createdAt DESC, id DESC LIMIT 90),
both_ AS (SELECT * FROM main UNION ALL SELECT id, createdAt, true, round(0.3 * exp(-0.05 * {AGE}) + 0.4 * ln({ENG} + 1) / 10 + 0.2 * {CRED} + 0.1 * CAST(authorId IN (1, 2) AS INT), 6) FROM pool)""",
)
def q2_home_feed(t):
    return feeds.home_feed(t.posts, t.users, t.follows, 1400, [1, 2], AS_OF, limit=30, exclude=[3, 4])


EDGES = "edges AS (SELECT id AS viewer, id AS author FROM users UNION SELECT followerId, followingId FROM follows WHERE followerId IN (SELECT id FROM users))"


@query(
    "SELECT viewer, place, id, false AS isBackfill, 0.0 AS score FROM m UNION ALL SELECT viewer, place, id, true, score FROM fill",
    AUTHORED
    + f""", {EDGES}, b AS (SELECT * FROM ap WHERE NOT isShort AND NOT inCommunity),
m AS (SELECT viewer, id, row_number() OVER (PARTITION BY viewer ORDER BY createdAt DESC, id DESC) AS place FROM edges JOIN b ON authorId = author QUALIFY row_number() OVER (PARTITION BY viewer ORDER BY createdAt DESC, id DESC) <= 30),
short AS (SELECT u.id AS viewer, count(m.id) AS n FROM users u LEFT JOIN m ON m.viewer = u.id GROUP BY u.id HAVING count(m.id) < 30),
others AS (SELECT viewer, n, b.*, row_number() OVER (PARTITION BY viewer ORDER BY createdAt DESC, id DESC) AS r FROM short JOIN b ON NOT EXISTS (SELECT 1 FROM edges e WHERE e.viewer = short.viewer AND e.author = b.authorId)),
scored AS (SELECT viewer, n, id, createdAt, round(0.3 * exp(-0.05 * {AGE}) + 0.4 * ln({ENG} + 1) / 10 + 0.2 * {CRED}, 6) AS score FROM others WHERE r <= 90),
fill AS (SELECT viewer, n + row_number() OVER (PARTITION BY viewer ORDER BY score DESC, createdAt DESC, id DESC) AS place, id, score FROM scored QUALIFY n + row_number() OVER (PARTITION BY viewer ORDER BY score DESC, createdAt DESC, id DESC) <= 30)""",
)
def q2_home_feeds_of_all(t):
    return everyone.home_feeds(t.posts, t.users, t.follows, AS_OF, limit=30)


@query(
    "SELECT id, score, createdAt FROM s WHERE score < 0.3 OR (score = 0.3 AND createdAt < TIMESTAMP '2000-01-01') ORDER BY score DESC, createdAt DESC, id LIMIT 25",
    AUTHORED + f", s AS (SELECT id, createdAt, round(0.4 * exp(-0.05 * {AGE}) + 0.4 * {ENG} / 100 + 0.2 * (0.4 * CAST(coalesce(verified, false) AS INT) + 0.25 * 0.5 + (1.0 / 11) * 0.1), 6) AS score FROM ap)",
)
def q3_hashtag_ranking(t):
    return feeds.ranked_by_tag(t.posts, t.users, AS_OF, 25, (0.3, "2000-01-01"))


def _paper_ctes(days: str) -> str:
    return (
        AUTHORED
        + f""", pool AS (SELECT *, row_number() OVER (ORDER BY createdAt DESC, id DESC) AS newest FROM ap WHERE NOT isShort AND createdAt <= TIMESTAMP '{AS_OF}'{days}),
sel AS (SELECT papers.*, coalesce(v.n, 0) AS n_viewed FROM papers LEFT JOIN (SELECT userId, count(DISTINCT postId) AS n FROM post_views GROUP BY userId) v ON v.userId = papers.authorId WHERE status = 'active'),
pairs AS (SELECT sel.id AS paper_id, sel.authorId AS reader, postCount, description, topic, excluded, second, stateNamed, language, audience, intent, focus, pool.* FROM sel JOIN pool ON newest <= 3 * postCount + n_viewed WHERE NOT EXISTS (SELECT 1 FROM post_views v WHERE v.userId = sel.authorId AND v.postId = pool.id)),
cand AS (SELECT * FROM pairs QUALIFY row_number() OVER (PARTITION BY paper_id ORDER BY createdAt DESC, id DESC) <= 3 * postCount),
feat AS (SELECT cand.*, u.state AS reader_state, u.interest AS reader_interest, EXISTS (SELECT 1 FROM follows f WHERE f.followerId = reader AND f.followingId = authorId) AS followed, {AGE} AS age,
 list_filter(regexp_split_to_array(lower(description), '[\\s,]+'), lambda w: length(w) > 3) AS words FROM cand LEFT JOIN users u ON u.id = reader),
kw AS (SELECT *, least(coalesce(len(list_filter(words, lambda w: contains(content, w))) / nullif(len(words), 0)::DOUBLE, 0), 1.0) AS share FROM feat)"""
    )


PCRED = "(0.5 * CAST(coalesce(verified, false) AS INT) + 0.3 * coalesce(followers, 0) / (coalesce(followers, 0) + 200.0) + 0.2 * coalesce(author_posts, 0) / (coalesce(author_posts, 0) + 100.0))"


@query(
    "SELECT paper_id, row_number() OVER (PARTITION BY paper_id ORDER BY score DESC, createdAt DESC, id) AS place, id, score FROM scored QUALIFY place <= postCount",
    _paper_ctes("")
    + f""", scored AS (SELECT *, round(0.25 * CASE WHEN age <= 24 THEN 1.0 ELSE exp(-0.03 * age) END + 0.30 * least(share + 0.3 * (CAST(contains(content, topic) AS INT) + CAST(contains(content, 'specified') AS INT)) / 2.0 + 0.1 * CAST(contains(content, second) AS INT), 1.0) + 0.15 * CASE WHEN author_state = reader_state THEN 1.0 WHEN stateNamed IN (CAST(author_state AS VARCHAR), CAST(reader_state AS VARCHAR)) AND author_state IS NOT NULL AND reader_state IS NOT NULL THEN 0.7 ELSE 0.0 END
 + 0.10 * (0.3 * CAST(language = 'english' AS INT) + 0.3 * CAST(coalesce(contains(lower(audience), lower(reader_interest)), false) AS INT) + 0.2 * CAST(intent IN ('news', 'informational') AS INT) + 0.2 * CAST(focus IN ('high', 'medium') AS INT))
 + 0.10 * ln(0.10 * views + 0.20 * likes + 0.35 * comments + 0.35 * shared + 1) / 15 + 0.05 * {PCRED} + 0.03 * CAST(followed AS INT) + 0.02 * CASE WHEN coalesce(contains(content, excluded), false) THEN 0.1 ELSE 1.0 END, 6) AS score FROM kw)""",
)
def q4_paper_recommendation(t):
    chosen = papers.spread(t.papers.where("status = 'active'")).select("id", "authorId", "postCount", "description", replies.metadata(F.col("reply")).alias("metadata"))
    return papers.recommend(chosen, t.posts, t.users, t.follows, t.post_views, AS_OF, readers=t.people)


@query(
    "SELECT paper_id, row_number() OVER (PARTITION BY paper_id ORDER BY score DESC, createdAt DESC, id) AS place, id, score FROM scored QUALIFY place <= postCount",
    _paper_ctes(f" AND createdAt >= TIMESTAMP '{AS_OF}' - INTERVAL 7 DAYS")
    + """, scored AS (SELECT *, round(0.25 * CASE WHEN age <= 24 THEN 1.0 WHEN age <= 72 THEN 0.8 ELSE exp(-0.02 * age) END + 0.30 * share + 0.15 * CASE WHEN author_state IS NULL OR reader_state IS NULL THEN 0.5 WHEN author_state = reader_state THEN 1.0 ELSE 0.3 END
 + 0.20 * least((0.4 * likes + 0.6 * comments + 0.8 * shared) / 100, 1.0) + 0.10 * CAST(followed AS INT), 6) AS score FROM kw)""",
)
def q5_scheduled_recommendation(t):
    return papers.recommend_scheduled(t.papers.where("status = 'active'"), t.posts, t.users, t.follows, t.post_views, AS_OF, readers=t.people)


@query(f"SELECT id, createdAt FROM posts WHERE NOT isShort AND createdAt BETWEEN TIMESTAMP '{AS_OF}' - INTERVAL 7 DAYS AND TIMESTAMP '{AS_OF}' AND id NOT IN (SELECT postId FROM post_views WHERE userId = 7) ORDER BY createdAt DESC, id DESC LIMIT 20")
def q6_quick_picks(t):
    return feeds.quick_picks(t.posts, t.post_views, VIEWER, AS_OF)


@query(
    "SELECT row_number() OVER (ORDER BY coalesce(verified, false) DESC, m DESC, id) AS place, id, CASE WHEN src = 1 THEN 'follows you' WHEN m > 0 THEN 'followed by people you follow' WHEN verified THEN 'verified' ELSE 'suggested' END AS reason, verified, m AS mutuals FROM picked",
    """mine AS (SELECT followingId AS id FROM follows WHERE followerId = 9), back AS (SELECT DISTINCT followerId AS id, 1 AS src FROM follows WHERE followingId = 9 AND followerId <> 9 AND followerId NOT IN (SELECT id FROM mine) ORDER BY 1 LIMIT 2),
hops AS (SELECT f.followingId AS id, count(*) AS paths FROM follows f JOIN mine ON mine.id = f.followerId WHERE f.followingId <> 9 AND f.followingId NOT IN (SELECT id FROM mine) AND f.followingId NOT IN (SELECT id FROM back) GROUP BY 1),
hop AS (SELECT id, 2 AS src FROM hops ORDER BY paths DESC, id LIMIT 4), fill AS (SELECT id, 3 AS src FROM users WHERE id <> 9 AND id NOT IN (SELECT id FROM mine) AND id NOT IN (SELECT id FROM back) AND id NOT IN (SELECT id FROM hop) ORDER BY md5('1:' || id), id LIMIT 4),
top4 AS (SELECT * FROM (SELECT * FROM back UNION ALL SELECT * FROM hop UNION ALL SELECT * FROM fill) ORDER BY src, id LIMIT 4),
picked AS (SELECT t.id, src, u.verified, (SELECT count(*) FROM follows f WHERE f.followingId = t.id AND f.followerId IN (SELECT id FROM mine)) AS m FROM top4 t LEFT JOIN users u ON u.id = t.id)""",
)
def q7_suggestions(t):
    return social.suggestions(t.users, t.follows, 9)


@query("SELECT u.id, username, verified, u.id IN (SELECT followingId FROM follows WHERE followerId = 7) AS followedByMe, (SELECT count(*) FROM follows a JOIN follows b ON a.followingId = b.followingId WHERE a.followerId = 7 AND b.followerId = u.id AND u.id <> 7) AS mutuals FROM users u WHERE u.id IN (SELECT followingId FROM follows WHERE followerId = 11) ORDER BY followedByMe DESC, verified DESC, u.id DESC LIMIT 20")
def q8_follow_list(t):
    return social.follow_list(t.users, t.follows, 7, 11)


@query("SELECT row_number() OVER (ORDER BY id <> 7, viewedAll, latest DESC, id) AS place, * FROM (SELECT userId AS id, count(*) AS stories, bool_and(storyId IN (SELECT storyId FROM story_views WHERE userId = 7)) AS viewedAll, max(createdAt) AS latest FROM stories WHERE createdAt BETWEEN TIMESTAMP '2024-01-14 12:00:00' AND TIMESTAMP '2024-01-15 12:00:00' AND (userId = 7 OR userId IN (SELECT followingId FROM follows WHERE followerId = 7)) GROUP BY userId)")
def q9_o12_story_tray(t):
    return social.story_tray(t.users, t.follows, t.stories, t.story_views, 7, "2024-01-15 12:00:00")


@query(
    "SELECT viewer, row_number() OVER (PARTITION BY viewer ORDER BY author <> viewer, viewedAll, latest DESC, author) AS place, author AS id, stories, viewedAll, latest FROM tray",
    f"{EDGES}, live AS (SELECT * FROM stories WHERE createdAt BETWEEN TIMESTAMP '2024-01-14 12:00:00' AND TIMESTAMP '2024-01-15 12:00:00'), tray AS (SELECT viewer, author, count(*) AS stories, bool_and(v.storyId IS NOT NULL) AS viewedAll, max(createdAt) AS latest FROM edges JOIN live s ON s.userId = author LEFT JOIN (SELECT DISTINCT userId, storyId FROM story_views) v ON v.userId = viewer AND v.storyId = s.storyId GROUP BY viewer, author)",
)
def q9_story_trays_of_all(t):
    return everyone.story_trays(t.users, t.follows, t.stories, t.story_views, "2024-01-15 12:00:00")


@query(
    "SELECT storyId, createdAt, storyId IN (SELECT storyId FROM story_views WHERE userId = 7) AS isViewed, storyId IN (SELECT storyId FROM story_likes WHERE userId = 7) AS isLiked, (SELECT count(DISTINCT v.userId) FROM story_views v WHERE v.storyId = s.storyId AND v.userId <> o.id) AS views, (SELECT string_agg(z_index || ':' || element_type || ':' || coalesce(position_x, 0) || ':' || coalesce(position_y, 0), ',' ORDER BY z_index) FROM story_elements e WHERE e.storyId = s.storyId) AS elements, prev_id, next_id FROM stories s JOIN o ON s.userId = o.id LEFT JOIN r ON r.id = o.id WHERE createdAt BETWEEN TIMESTAMP '2024-01-14 12:00:00' AND TIMESTAMP '2024-01-15 12:00:00'",
    """o AS (SELECT userId AS id FROM stories WHERE createdAt BETWEEN TIMESTAMP '2024-01-14 12:00:00' AND TIMESTAMP '2024-01-15 12:00:00' ORDER BY storyId LIMIT 1), p AS (SELECT 0 AS later, 7 AS id UNION SELECT 1, followingId FROM follows WHERE followerId = 7),
r AS (SELECT id, coalesce(lag(id) OVER w, last_value(id) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS prev_id, coalesce(lead(id) OVER w, first_value(id) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS next_id FROM p WINDOW w AS (ORDER BY later, id))""",
)
def q10_user_stories(t):
    now = F.lit("2024-01-15 12:00:00").cast("timestamp_ntz")
    owner = t.stories.where((F.col("createdAt") >= now - F.expr("INTERVAL 24 HOURS")) & (F.col("createdAt") <= now)).orderBy("storyId").first()
    df = social.user_stories(t.stories, t.story_views, t.story_likes, t.story_elements, t.follows, owner["userId"] if owner else -1, 7, "2024-01-15 12:00:00")
    line = F.transform("elements", lambda e: F.concat_ws(":", e["z_index"], e["type"], e["x"], e["y"]))
    return df.withColumn("elements", F.array_join(line, ","))


@query("SELECT postId, id, createdAt, id IN (SELECT commentId FROM comment_likes WHERE userId = 7) AS isLiked, (SELECT count(*) FROM comments r WHERE r.parentId = c.id) AS replies, (SELECT count(*) FROM comments a WHERE a.postId = c.postId) AS total, count(*) OVER (PARTITION BY postId) > 2 AS hasMore FROM comments c WHERE parentId IS NULL QUALIFY row_number() OVER (PARTITION BY postId ORDER BY createdAt DESC, id DESC) <= 2")
def q11_threads(t):
    return threads.threads(t.comments, t.comment_likes, 7, n=2)


@query("SELECT roomId, kind, id, sentAt FROM la WHERE sentAt < 40005 OR (sentAt = 40005 AND roomId < 40) ORDER BY sentAt DESC, roomId DESC LIMIT 12", ACTIVITY)
def q13_o9_recent_rooms(t):
    return chat.recent_rooms(t.messages, t.reactions, (40005, 40))


@query("SELECT m.id, m.senderId, m.sentAt, (SELECT count(*) FROM reactions r WHERE r.messageId = m.id) AS reactions, m.replyTo, q.senderId AS quotedSender FROM (SELECT * FROM messages WHERE roomId = 12 AND NOT deleted AND ((senderId = 'user' AND NOT senderDeleted) OR (senderId <> 'user' AND NOT receiverDeleted)) ORDER BY sentAt DESC, id DESC LIMIT 20) m LEFT JOIN messages q ON q.id = m.replyTo")
def q14_o15_message_page(t):
    return chat.message_page(t.messages, t.reactions, 12, "user")


@query(
    "SELECT CAST(score AS VARCHAR) AS bucket, score, word FROM (SELECT word, 10 * count(*) AS score FROM (SELECT unnest(list_filter(regexp_extract_all(lower(text), '([a-z0-9]+)', 1), lambda w: length(w) >= 3 AND w NOT IN ('and', 'are', 'for', 'from', 'has', 'its', 'that', 'the', 'this', 'was', 'were', 'will', 'with'))) AS word FROM d) GROUP BY word) UNION ALL SELECT DISTINCT 'hashtags', 100, unnest(regexp_extract_all(lower(text), '(#[a-z0-9_]+)', 1)) FROM d UNION ALL SELECT DISTINCT 'mentions', 80, unnest(regexp_extract_all(lower(text), '(@[a-z0-9_]+)', 1)) FROM d",
    """l AS (SELECT postId, interactionType FROM interactions WHERE userId = 7 ORDER BY updatedAt DESC, id DESC LIMIT 200), ids AS (SELECT postId FROM l WHERE interactionType IN ('recommended', 'commented', 'liked', 'saved', 'read') UNION SELECT descendantId FROM post_relations JOIN l ON ancestorId = postId WHERE depth = 1 AND interactionType IN ('recommended', 'saved', 'read')), d AS (SELECT * FROM documents WHERE doc_id IN (SELECT postId FROM ids))""",
)
def q15_udf2_keyword_matrix(t):
    last = t.interactions.where("userId = 7").orderBy(F.desc("updatedAt"), F.desc("id")).limit(200).select("postId", "interactionType")
    below = t.post_relations.where("depth = 1").join(last.where("interactionType IN ('recommended', 'saved', 'read')"), F.col("ancestorId") == F.col("postId")).select(F.col("descendantId").alias("postId"))
    ids = last.where("interactionType IN ('recommended', 'commented', 'liked', 'saved', 'read')").select("postId").unionByName(below).distinct()
    return text.keyword_matrix(t.documents.join(ids, F.col("doc_id") == F.col("postId"), "left_semi"), "text")


HOUR = f"({MINUTE} // 60)"


@query(f"""SELECT id, CAST(paperDate AS VARCHAR) AS paperDate FROM (SELECT id, CASE WHEN NOT td AND (14 = hour OR 13 >= hour) THEN DATE '2024-01-15' WHEN td AND NOT tm AND 14 = hour THEN DATE '2024-01-16' END AS paperDate FROM (SELECT id, {HOUR} AS hour, EXISTS (SELECT 1 FROM editions e WHERE e.paperId = p.id AND paperDate = DATE '2024-01-15') AS td, EXISTS (SELECT 1 FROM editions e WHERE e.paperId = p.id AND paperDate = DATE '2024-01-16') AS tm FROM papers p WHERE status = 'active' AND processingStatus = 'completed' AND NOT deleted)) WHERE paperDate IS NOT NULL""")
def q16_due_editions(t):
    return papers.due(t.papers, t.editions, NOW).withColumn("paperDate", F.col("paperDate").cast("string"))


@query(f"SELECT id, CASE WHEN status = 'scheduled' AND paperDate = DATE '2024-01-15' AND 835 >= {MINUTE} AND NOT ({MINUTE} < 60) THEN 'delivered' ELSE status END AS status FROM editions")
def q17_deliver(t):
    return papers.deliver(t.editions, NOW).select("id", "status")


@query("SELECT id FROM editions WHERE paperDate >= DATE '2024-01-08'")
def q18_retention(t):
    return papers.retained(t.editions, "2024-01-15").select("id")


@query("SELECT n.id, type, u.username, is_read, n.createdAt, p.isShort FROM (SELECT * FROM notifications WHERE user_id = 21 ORDER BY createdAt DESC, id DESC LIMIT 30) n LEFT JOIN users u ON u.id = n.sender_id LEFT JOIN posts p ON p.id = n.reference_id WHERE reference_id IS NULL OR p.id IS NOT NULL")
def q19_notifications(t):
    return threads.notification_page(t.notifications, t.users, t.posts, 21)


@query("SELECT p.id, pinned, date_posted, username, verified, p.id IN (SELECT postId FROM post_likes WHERE userId = 7) AS isLiked, p.id IN (SELECT postId FROM post_saved WHERE userId = 7) AS isSaved, count(*) OVER () AS total, CAST(ceil(count(*) OVER () / 10.0) AS BIGINT) AS pages, count(*) OVER () > 10 AS hasMore FROM community_posts c JOIN posts p ON p.id = c.post_id LEFT JOIN users u ON u.id = p.authorId WHERE community_id = 3 AND NOT removed AND NOT isShort ORDER BY pinned DESC, date_posted DESC, p.id DESC LIMIT 10")
def q20_community_posts(t):
    return feeds.community_page(t.community_posts, t.posts, t.users, t.post_likes, t.post_saved, 7, 3, limit=10)


# ---- counters


@query("SELECT postId, count(*) AS comments, count(*) FILTER (WHERE parentId IS NULL) AS roots FROM comments GROUP BY postId")
def ctr_comments(t):
    return counters.comment_counts(t.comments)


@query("SELECT id, CAST(sum(a) AS BIGINT) AS following, CAST(sum(b) AS BIGINT) AS followers FROM (SELECT followerId AS id, 1 AS a, 0 AS b FROM follows UNION ALL SELECT followingId, 0, 1 FROM follows) GROUP BY id")
def ctr_follows(t):
    return counters.follow_counts(t.follows)


@query("SELECT community_id, count(DISTINCT user_id) AS member_count FROM memberships WHERE status = 'active' GROUP BY community_id")
def ctr_members(t):
    return counters.member_counts(t.memberships)


@query("SELECT id, CAST(sum(n) AS BIGINT) AS posts FROM (SELECT authorId AS id, 1 AS n FROM posts UNION ALL SELECT userId, 1 FROM stories) WHERE id IS NOT NULL GROUP BY id")
def ctr_author_posts(t):
    return counters.author_counts(t.posts, t.stories)


@query("SELECT tag, count(*) AS n FROM (SELECT DISTINCT doc_id, lower(unnest(regexp_extract_all(x, '#([a-zA-Z0-9_]+)', 1))) AS tag FROM (SELECT doc_id, '#' || source || ' #' || lang || ' ' || text AS x FROM documents)) GROUP BY tag")
def ctr_hashtags(t):
    return counters.tag_counts(t.documents, text.tags(F.concat(F.lit("#"), "source", F.lit(" #"), "lang", F.lit(" "), "text")))


# ---- live activity, as batches (the tests run the same functions on streams)


@query("SELECT user_id, min(ts) AS \"start\", max(ts) + INTERVAL 20 MINUTES AS \"end\", count(*) AS events FROM (SELECT *, sum(g) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 20 MINUTES THEN 0 ELSE 1 END AS g FROM events)) GROUP BY user_id, s")
def st1_sessions(t):
    return activity.sessions(t.events, "user_id", "ts")


@query("SELECT CAST(user_id AS VARCHAR) AS key, bool_or(kind IN ('click', 'signup')) AS online FROM (SELECT user_id, event_id % 3 AS socket, arg_max(event_type, (epoch_ms(ts), event_id)) AS kind FROM events WHERE event_type IN ('click', 'signup', 'view', 'error') GROUP BY 1, 2) GROUP BY user_id")
def st2_presence(t):
    e = t.events.where(F.col("event_type").isin("click", "signup", "view", "error")).withColumn("socket", F.col("event_id") % 3)
    return state.online(e, "user_id", "socket", F.col("event_type").isin("click", "signup"), "ts", "event_id")


@query("SELECT id, isRead OR (sentAt <= roomId * 1000 + 3 AND senderId <> 'user') AS isRead FROM messages")
def st3_read_receipts(t):
    entered = t.messages.select("roomId").distinct().select("roomId", F.lit("user").alias("userId"), (F.col("roomId") * 1000 + 3).alias("sentAt"))
    return activity.read_receipts(t.messages, entered).select("id", "isRead")


@query("SELECT e.event_id, (SELECT arg_max(o.event_type, (epoch_ms(o.ts), o.event_id)) FROM events o WHERE o.user_id = e.user_id AND o.event_type IN ('view', 'error') AND (epoch_ms(o.ts), o.event_id) < (epoch_ms(e.ts), e.event_id)) IS NOT DISTINCT FROM 'view' AS asRead FROM events e WHERE e.event_type = 'click'")
def st4_delivered_as_read(t):
    turns = t.events.where("event_type IN ('view', 'error')")
    out = state.delivered_as_read(t.events.where("event_type = 'click'"), turns, F.col("event_type") == "view", "user_id", "user_id", "user_id", "ts", "event_id")
    return out.select("event_id", "asRead")


@query("SELECT CAST(user_id AS VARCHAR) AS key, CAST(k AS VARCHAR) AS member, value FROM (SELECT user_id, event_id % 5 AS k, arg_max(event_type, (epoch_ms(ts), event_id)) AS value FROM events GROUP BY 1, 2) WHERE value <> 'error'")
def st5_last_value(t):
    e = t.events.withColumn("k", F.col("event_id") % 5)
    return state.current(e, ["user_id"], "k", F.nullif(F.col("event_type"), F.lit("error")), "ts", "event_id")


@query("SELECT CAST(user_id AS VARCHAR) AS key, type || ':' || sender_id || ':' || coalesce(CAST(reference_id AS VARCHAR), '-') AS member, CAST(max_by(id, (epoch_ms(createdAt), id)) AS VARCHAR) AS value FROM notifications GROUP BY 1, 2 HAVING max_by(id, (epoch_ms(createdAt), id)) % 6 <> 5")
def st6_notification_dedupe(t):
    # every sixth event takes its notification back
    n = t.notifications.withColumn("what", F.concat_ws(":", "type", "sender_id", F.coalesce(F.col("reference_id").cast("string"), F.lit("-"))))
    return state.current(n, ["user_id"], "what", F.when(F.col("id") % 6 != 5, F.col("id")), "createdAt", "id")


@query("SELECT count(*) AS n FROM (SELECT DISTINCT userId, postId FROM post_views)")
def st7_idempotent_views(t):
    return activity.once(t.post_views, ["userId", "postId"], "updatedAt").agg(F.count("*").alias("n"))


@query("SELECT storyId FROM stories WHERE createdAt >= TIMESTAMP '2024-01-14 12:00:00' AND createdAt <= TIMESTAMP '2024-01-15 12:00:00'")
def st8_story_ttl(t):
    now = F.lit("2024-01-15 12:00:00").cast("timestamp_ntz")
    return t.stories.where((F.col("createdAt") >= now - F.expr("INTERVAL 24 HOURS")) & (F.col("createdAt") <= now)).select("storyId")


@query("SELECT user_id, time_bucket(INTERVAL 500 MILLISECONDS, ts) AS window_start, arg_max(event_type, (ts, event_id)) AS event_type FROM events GROUP BY 1, 2")
def st10_collapsed_toggles(t):
    return activity.collapsed(t.events, ["user_id"], "ts", "event_type", "event_id")
