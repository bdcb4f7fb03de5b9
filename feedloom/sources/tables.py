"""Tables: reading, registering, and the social views over the driver's tables.

The views are plain SQL that Spark and the test oracle both run; ``{name}`` stands for another table or view.
"""

from __future__ import annotations

import re
from collections import Counter
from functools import cache
from time import sleep

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BASE = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

VIEWS: dict[str, str] = {
    "follows": "SELECT DISTINCT o_custkey AS followerId, l_suppkey AS followingId FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey WHERE o_custkey <> l_suppkey",
    "people": "SELECT c_custkey AS id, c_name AS username, c_mktsegment = 'BUILDING' AS verified, c_nationkey AS state, c_acctbal AS balance, c_mktsegment AS interest FROM {customer}",
    "users": """SELECT u.*, coalesce(f.n, 0) AS followers, coalesce(p.n, 0) AS posts FROM {people} u
 LEFT JOIN (SELECT followingId, count(*) AS n FROM {follows} GROUP BY followingId) f ON f.followingId = u.id
 LEFT JOIN (SELECT o_custkey, count(*) AS n FROM {orders} GROUP BY o_custkey) p ON p.o_custkey = u.id""",
    "posts": """SELECT o_orderkey AS id, o_custkey AS authorId, o_orderdate AS createdAt, o_orderstatus = 'P' AS isShort, o_orderpriority = '5-LOW' AS inCommunity,
 o_orderpriority AS category, lower(o_orderpriority) AS content, coalesce(views, 0) AS views, coalesce(likes, 0) AS likes, coalesce(comments, 0) AS comments, coalesce(shared, 0) AS shared, coalesce(bookmarks, 0) AS bookmarks
 FROM {orders} LEFT JOIN (SELECT l_orderkey, CAST(sum(l_quantity) AS BIGINT) AS views, count(*) AS likes, count(CASE WHEN l_returnflag = 'R' THEN 1 END) AS comments,
 count(CASE WHEN l_linestatus = 'O' THEN 1 END) AS shared, count(CASE WHEN l_linenumber > 5 THEN 1 END) AS bookmarks FROM {lineitem} GROUP BY l_orderkey) c ON c.l_orderkey = o_orderkey""",
    "interactions": """SELECT event_id AS id, user_id AS userId, event_id % (SELECT count(*) FROM {orders}) AS postId,
 CASE event_type WHEN 'view' THEN 'read' WHEN 'click' THEN 'liked' WHEN 'signup' THEN 'saved' WHEN 'purchase' THEN 'shared' ELSE CASE WHEN event_id % 2 = 0 THEN 'recommended' ELSE 'reported' END END AS interactionType, ts AS updatedAt FROM {events}""",
    "post_views": "SELECT userId, postId, updatedAt FROM {interactions} WHERE interactionType = 'read'",
    "post_likes": "SELECT userId, postId, updatedAt FROM {interactions} WHERE interactionType = 'liked'",
    "post_saved": "SELECT userId, postId, updatedAt FROM {interactions} WHERE interactionType = 'saved'",
    "messages": """SELECT conv_id * 100 + turn AS id, conv_id AS roomId, role AS senderId, text AS content, conv_id * 1000 + turn AS sentAt, turn % 3 = 1 AS isRead, turn % 5 = 4 AS deleted,
 conv_id % 7 = 0 AND turn % 2 = 0 AS senderDeleted, conv_id % 5 = 0 AND turn % 2 = 1 AS receiverDeleted, CASE WHEN turn >= 2 AND turn % 2 = 0 THEN conv_id * 100 + turn - 3 + turn % 4 END AS replyTo FROM {conversations}""",
    "reactions": "SELECT id * 10 AS id, id AS messageId, roomId, 'user' AS senderId, 'heart' AS reaction, sentAt + 2 AS sentAt, roomId % 2 = 0 AS isRead FROM {messages} WHERE sentAt % 3 = 2",
    "comments": """SELECT l_orderkey * 10 + l_linenumber AS id, l_orderkey AS postId, min(l_suppkey) AS authorId, min(l_shipdate) AS createdAt, l_linenumber = 4 AS isPinned,
 CASE WHEN l_linenumber % 3 <> 1 THEN l_orderkey * 10 + l_linenumber - (l_linenumber + 2) % 3 END AS parentId FROM {lineitem} GROUP BY l_orderkey, l_linenumber""",
    "comment_likes": "SELECT user_id AS userId, (event_id % (SELECT count(*) FROM {orders})) * 10 + 1 AS commentId FROM {events} WHERE event_type = 'click'",
    "notifications": """SELECT event_id AS id, (event_id * 7) % 150 AS user_id, user_id AS sender_id, CASE event_type WHEN 'click' THEN 'like' WHEN 'signup' THEN 'follow' WHEN 'view' THEN 'comment' ELSE 'share' END AS type,
 CASE WHEN event_type = 'signup' THEN NULL ELSE (event_id * 3) % (2 * (SELECT count(*) FROM {orders})) END AS reference_id, event_id % 4 = 0 AS is_read, ts AS createdAt FROM {events}""",
    "stories": "SELECT event_id AS storyId, user_id AS userId, ts AS createdAt FROM {events} WHERE event_type = 'purchase'",
    "story_views": "SELECT user_id AS userId, (event_id * 7) % (SELECT count(*) FROM {events}) AS storyId FROM {events} WHERE event_type = 'view'",
    "story_likes": "SELECT user_id AS userId, (event_id * 11) % (SELECT count(*) FROM {events}) AS storyId FROM {events} WHERE event_type = 'click'",
    "story_elements": "SELECT storyId, k AS z_index, CASE WHEN (storyId + k) % 2 = 0 THEN 'text' ELSE 'image' END AS element_type, storyId % 300 AS position_x, CASE WHEN k = 2 THEN NULL ELSE k * 10 END AS position_y FROM {stories} CROSS JOIN (SELECT 1 AS k UNION ALL SELECT 2) ks",
    "post_relations": "SELECT o_orderkey AS ancestorId, o_orderkey + 1 AS descendantId, 1 AS depth FROM {orders} WHERE o_orderpriority = '2-HIGH' UNION ALL SELECT o_orderkey, o_orderkey, 0 FROM {orders}",
    "post_parents": "SELECT o_orderkey AS id, CAST(floor(o_orderkey / 2) AS BIGINT) AS parentId FROM {orders} WHERE o_orderkey > 1",
    "communities": "SELECT n_nationkey AS id, n_name AS name, n_nationkey AS creator_id, CASE n_nationkey % 3 WHEN 0 THEN 'everyone' WHEN 1 THEN 'creator' ELSE 'moderators' END AS post_access_type, CASE n_nationkey % 4 WHEN 0 THEN 'private' ELSE 'public' END AS visibility FROM {nation}",
    "memberships": "SELECT c_custkey AS user_id, c_nationkey AS community_id, CASE WHEN c_custkey % 10 = 0 THEN 'moderator' ELSE 'member' END AS role, CASE WHEN c_custkey % 11 = 0 THEN 'left' WHEN c_custkey % 23 = 0 THEN 'banned' ELSE 'active' END AS status FROM {customer}",
    "community_posts": "SELECT c_nationkey AS community_id, o_orderkey AS post_id, o_orderdate AS date_posted, o_orderkey % 13 = 0 AS pinned, o_orderkey % 17 = 0 AS removed FROM {orders} JOIN {customer} ON o_custkey = c_custkey WHERE o_orderpriority = '5-LOW'",
    "papers": """SELECT *, concat('```json ', chr(123), '"primary_topics": ["', topic, '", "specified"], "secondary_topics": ["', second, '"], "regions": ', chr(123), '"states": ["', stateNamed, '"]', chr(125),
 ', "excluded_topics": [', coalesce(concat('"' || excluded, '"'), ''), '], "language": "', language, '", "audience": ', coalesce('"' || audience || '"', 'null'), ', "intent_type": "', intent, '", "focus_level": "', focus, '"', chr(125), ' ```') AS reply,
 CASE postCount % 4 WHEN 0 THEN concat('```json ["', topic, '", "', second, '", "', language, '", "', intent, '", "', focus, '", "', stateNamed, '"] ```') WHEN 1 THEN concat('  ["', topic, '"] ') WHEN 2 THEN '[]' ELSE 'I am sorry' END AS categoriesReply
 FROM (SELECT p_partkey AS id, p_name AS title, p_partkey % (SELECT count(*) FROM {customer}) AS authorId, concat(CAST(1 + p_size % 12 AS STRING), CASE WHEN p_size % 2 = 0 THEN ':00 ' ELSE ':30 ' END, CASE WHEN p_size > 25 THEN 'PM' ELSE 'AM' END) AS deliveryTime,
 10 + p_size % 20 AS postCount, CASE WHEN p_size % 10 = 9 THEN 'paused' ELSE 'active' END AS status, CASE WHEN p_size % 7 = 6 THEN 'pending' ELSE 'completed' END AS processingStatus, p_size % 8 = 7 AS deleted,
 CASE p_size % 4 WHEN 0 THEN 'Daily urgent news' WHEN 1 THEN 'all the high medium news' WHEN 2 THEN 'specified things, specified' ELSE 'a low bar' END AS description,
 CASE p_size % 3 WHEN 0 THEN 'urgent' WHEN 1 THEN 'high' ELSE 'medium' END AS topic, CASE WHEN p_size % 5 = 0 THEN 'specified' END AS excluded,
 CASE WHEN p_size % 2 = 0 THEN 'low' ELSE 'medium' END AS second, CAST(p_size % 25 AS STRING) AS stateNamed, CASE WHEN p_size % 2 = 0 THEN 'english' ELSE 'hindi' END AS language,
 CASE p_size % 3 WHEN 0 THEN 'Building trade' WHEN 1 THEN 'machinery and household' END AS audience, CASE p_size % 4 WHEN 0 THEN 'news' WHEN 1 THEN 'informational' ELSE 'analysis' END AS intent,
 CASE p_size % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'broad' ELSE 'medium' END AS focus FROM {part}) p""",
    "editions": """SELECT p_partkey * 10 + k AS id, p_partkey AS paperId, CASE k WHEN 0 THEN DATE '2024-01-14' WHEN 1 THEN DATE '2024-01-15' ELSE DATE '2024-01-01' END AS paperDate,
 concat(CAST(1 + p_size % 12 AS STRING), ':00 ', CASE WHEN p_size > 25 THEN 'PM' ELSE 'AM' END) AS deliveryTime, CASE WHEN (p_partkey + k) % 2 = 0 THEN 'scheduled' ELSE 'delivered' END AS status, p_partkey % 3 = 0 AS isRead,
 p_partkey % (SELECT count(*) FROM {orders}) AS p1, (p_partkey * 7 + 3) % (2 * (SELECT count(*) FROM {orders})) AS p2, (p_partkey * 13 + 5) % (SELECT count(*) FROM {orders}) AS p3
 FROM {part} CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 1 UNION ALL SELECT 2) ks WHERE (p_partkey + k) % 3 <> 0""",
}

_NAME = re.compile(r"\{(\w+)\}")


#: What tells a lost connection from any other error: classes of JDBC and of the network, and the class of SQL states.
LOST = ("java.sql.SQLTransientException", "java.sql.SQLTransientConnectionException", "java.sql.SQLRecoverableException", "java.sql.SQLNonTransientConnectionException", "java.net.ConnectException", "java.net.SocketException", "java.net.SocketTimeoutException", "java.net.UnknownHostException")
LOST_STATE = "08"
#: Seconds that are waited for a connection at most.
LONGEST_WAIT = 30.0


def lost_connection(error: Exception) -> bool:
    """Whether an error of Spark's comes from a connection that failed."""
    cause = getattr(error, "java_exception", None) or getattr(error, "_origin", None)
    while cause is not None:
        names = {c.getName() for c in (cause.getClass(), cause.getClass().getSuperclass()) if c is not None}
        if names & set(LOST):
            return True
        if hasattr(cause, "getSQLState") and "SQLException" in " ".join(names) and str(cause.getSQLState() or "").startswith(LOST_STATE):
            return True
        cause = cause.getCause()
    return False


def patiently(work, attempts: int = 5, wait: float = 1.0):
    """What work returns; a lost connection is tried again, each time after twice the wait, other errors are not."""
    for n in range(1, attempts + 1):
        try:
            return work()
        except (Py4JJavaError, PySparkException) as e:
            if n == attempts or not lost_connection(e):
                raise
            sleep(min(LONGEST_WAIT, wait * 2 ** (n - 1)))
    raise ValueError("attempts must be at least 1")


def balanced_ranges(keys: DataFrame, key: str, name: str, partitions: int) -> list[str]:
    """SQL conditions, on a column by its name there, that part rows by ranges of a numeric key which hold about as many rows each; a value that fills several ranges has one
    to itself, nulls come with the first."""
    marks = [F.lit(k / partitions) for k in range(1, partitions)]
    found = keys.agg(F.percentile_approx(key, F.array(*marks), 100 * partitions).alias("q")).first()["q"] if marks else []
    cuts = sorted(set(found or []))
    # a value that is cut at again and again ends its own range as well
    heavy = [a for a, n in Counter(found or []).items() if n > 1]
    edges = [(c, "<") for c in cuts] + [(c, "<=") for c in heavy]
    edges.sort()
    below = [f"{name} {op} {c}" for c, op in edges]
    above = [f"{name} {'>=' if op == '<' else '>'} {c}" for c, op in edges]
    if not edges:
        return ["1 = 1"]
    return [f"{below[0]} OR {name} IS NULL", *[f"{a} AND {b}" for a, b in zip(above, below[1:], strict=False)], above[-1]]


def read_jdbc(spark: SparkSession, url: str, table: str, key: str | None = None, partitions: int = 64, attempts: int = 5, wait: float = 1.0, **options: str) -> DataFrame:
    """A database table, read in balanced ranges of a numeric ``key`` where one is given.

    The ranges come from the key's quantiles, for which the key alone is read once, in even ranges between its ends. A connection
    that is lost is tried again with a wait of at most 30 s; any other error, like a table that isn't there, is one at once.
    """
    plain = lambda what, **more: patiently(lambda: spark.read.format("jdbc").options(url=url, dbtable=what, **options, **more).load(), attempts, wait)
    if key is None or partitions < 2:
        return plain(table)
    name = spark.sparkContext._jvm.org.apache.spark.sql.jdbc.JdbcDialects.get(url).quoteIdentifier(key)
    ends = patiently(lambda: plain(f"(SELECT MIN({name}) AS lo, MAX({name}) AS hi FROM {table}) ends").first(), attempts, wait)
    low, high = (next(v for k, v in ends.asDict().items() if k.lower() == n) for n in ("lo", "hi"))
    if low is None or low == high:
        return plain(table)
    keys = plain(f"(SELECT {name} FROM {table}) ks", partitionColumn=key, lowerBound=str(low), upperBound=str(high), numPartitions=str(partitions))
    ranges = patiently(lambda: balanced_ranges(keys, key, name, partitions), attempts, wait)
    return patiently(lambda: spark.read.jdbc(url, table, predicates=ranges, properties=options), attempts, wait)


def register(spark: SparkSession, sf_dir: str) -> list[str]:
    """Every base table as a temporary view of its name."""
    for name in BASE:
        spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)
    return list(BASE)


class Tables:
    """Base tables and views of one directory, as attributes, each planned when it is first asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir, self._held = spark, sf_dir, {}

    def __getattr__(self, name: str) -> DataFrame:
        if name not in self._held:
            if name in BASE:
                self._held[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
            elif name in VIEWS:
                self._held[name] = self.spark.sql(VIEWS[name], **{n: getattr(self, n) for n in set(_NAME.findall(VIEWS[name]))})
            else:
                raise AttributeError(name)
        return self._held[name]


@cache
def _needs(name: str) -> tuple[str, ...]:
    out: list[str] = []
    for n in _NAME.findall(VIEWS.get(name, "")):
        out += [*_needs(n), n]
    return tuple(dict.fromkeys(n for n in out if n in VIEWS))


def oracle(body: str, ctes: str = "") -> str:
    """SQL for the test oracle: the views that body names, written out before it."""
    named = [v for v in VIEWS if re.search(rf"\b{v}\b", body + " " + ctes)]
    order = list(dict.fromkeys(n for v in named for n in (*_needs(v), v)))
    parts = [f"{v} AS ({_NAME.sub(lambda m: m[1], VIEWS[v])})" for v in order] + ([ctes] if ctes else [])
    return (f"WITH {', '.join(parts)} " if parts else "") + body


#: Cities, their states and other spellings that text is searched for; a sample that a caller replaces.
CITIES = (("bengaluru", "Karnataka", ("bangalore",)), ("mysuru", "Karnataka", ("mysore",)), ("belagavi", "Karnataka", ("belgaum", "belgavi", "belgam")), ("mumbai", "Maharashtra", ("bombay",)), ("pune", "Maharashtra", ("poona",)), ("new delhi", "Delhi", ("delhi",)), ("chennai", "Tamil Nadu", ("madras",)), ("kolkata", "West Bengal", ("calcutta",)), ("hyderabad", "Telangana", ()), ("navi mumbai", "Maharashtra", ()))
#: Fixed value: a city whose spellings count wherever they stand, before all others.
FIRST_CITY = "belagavi"


def gazetteer(spark: SparkSession, cities: tuple = CITIES, table: DataFrame | None = None) -> DataFrame:
    """(name, city, state, variant, first, at): every spelling of every city in the table's order, the city's own name first; from a
    table of (city, state, spellings, place) where one is given. A name is a variant if its city has several spellings."""
    if table is not None:
        rows = table.select(F.lower("city").alias("city"), "state", F.coalesce("spellings", F.array()).alias("o"), F.col("place").cast("long").alias("place"))
    else:
        rows = spark.createDataFrame([(c, s, list(o), k) for k, (c, s, o) in enumerate(cities)], "city string, state string, o array<string>, place long")
    names = rows.select("city", "state", (F.size("o") > 0).alias("variant"), "place", F.posexplode(F.concat(F.array("city"), F.transform("o", F.lower))).alias("k", "name"))
    return names.select("name", "city", "state", "variant", (F.col("city") == FIRST_CITY).alias("first"), (F.col("place") * 1000 + F.col("k")).alias("at"))
