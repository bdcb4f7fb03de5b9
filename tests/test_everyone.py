"""Plans for all users against the functions for one viewer, with hubs that are split."""

import random
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from feedloom.operators import hops
from feedloom.operators import relational as rel
from feedloom.plans import everyone, feeds, social


@pytest.fixture(scope="module")
def people(spark):
    r = random.Random(7)
    n = 24
    edges = {(v, 0) for v in range(1, n)} | {(0, v) for v in range(1, n, 2)} | {(r.randrange(n), r.randrange(n)) for _ in range(60)}
    follows = spark.createDataFrame([(a, b) for a, b in edges if a != b and a != 20] + [(1, 0), (77, 3), (None, 3), (3, None)], "followerId long, followingId long")
    users = spark.createDataFrame([(i, i % 3 == 0, i * 5, i % 4, i) for i in range(n)], "id long, verified boolean, followers long, posts long, state long")
    posts = spark.createDataFrame([(i, r.choice([None, *range(n)]), i % 7 == 0, i % 11 == 0, i, i % 5, i % 3, 0, 1, f"2024-01-{1 + i % 20:02d} 00:00:00") for i in range(90)], "id long, authorId long, isShort boolean, inCommunity boolean, views long, likes long, comments long, shared long, bookmarks long, at string").withColumn("createdAt", F.col("at").cast("timestamp_ntz"))
    return n, users, follows.cache(), posts


@pytest.mark.parametrize("together", [3, everyone.TOGETHER])
def test_home_feeds(spark, people, together):
    n, users, follows, posts = people
    got = {}
    for x in everyone.home_feeds(posts, users, follows, "2024-02-01", limit=12, together=together).collect():
        got.setdefault(x["viewer"], []).append((x["place"], x["id"], x["isBackfill"], x["score"]))
    for v in (0, 1, 5, 20):
        want = [tuple(x) for x in feeds.home_feed(posts, users, follows, v, [], "2024-02-01", limit=12).collect()]
        assert sorted(got[v]) == sorted(want), v
    assert any(b for _, _, b, _ in got[20]) and set(got) == set(range(n))


@pytest.mark.parametrize("together", [2, everyone.TOGETHER])
def test_two_hops(people, together):
    n, _, follows, _ = people
    got = {}
    for x in everyone.two_hops(follows, 5, together).orderBy("place").collect():
        got.setdefault(x["viewer"], []).append((x["id"], x["paths"]))
    for v in (0, 2, 7, 77):
        want = rel.two_hop(follows.distinct(), v).orderBy(F.desc("paths"), "id").limit(5).collect()
        assert got.get(v, []) == [tuple(x) for x in want], v


def plain_two_hops(edges, n):
    """(viewer, id, paths, place) by hand."""
    lists = {}
    for a, b in edges:
        lists.setdefault(a, set()).add(b)
    out = []
    for v, own in lists.items():
        paths = Counter(x for w in own for x in lists.get(w, ()) if x != v and x not in own)
        out += [(v, x, c, k) for k, (x, c) in enumerate(sorted(paths.items(), key=lambda p: (-p[1], p[0]))[:n], 1)]
    return sorted(out)


@pytest.mark.parametrize("kind", ["long", "int", "string"])
@pytest.mark.parametrize("together, edges", [(40, 30), (everyone.LISTS, everyone.EDGES)])
def test_two_hops_by_hand(spark, kind, together, edges):
    r = random.Random(5)
    wide = (1 << 62) - 7 if kind == "long" else 0
    name = (lambda x: f"u{x}") if kind == "string" else lambda x: x * (-1 if x % 5 == 0 else 1) + wide * (x % 3 - 1)
    ends = [(r.randrange(90), min(r.randrange(90), r.randrange(90))) for _ in range(900)] + [(91, x) for x in range(80)] + [(x, 92) for x in range(60)] + [(92, x) for x in range(40)] + [(93, 94), (94, 93), (95, 95), (95, 96)]
    pairs = [(name(a), name(b)) for a, b in ends]
    follows = spark.createDataFrame(pairs + pairs[:9], f"followerId {kind}, followingId {kind}")
    got = everyone.two_hops(follows, 3, together, edges)
    assert [f.dataType.simpleString() for f in got.schema] == [kind.replace("long", "bigint")] * 2 + ["bigint", "int"]
    assert sorted(map(tuple, got.collect())) == plain_two_hops(pairs, 3)


def test_two_hops_of_none(spark):
    assert everyone.two_hops(spark.createDataFrame([(None, 1), (1, None)], "followerId long, followingId long"), 3).count() == 0


def test_two_hops_send_no_paths(spark):
    """400 people follow the same 40, who follow 1,000 each: 56,000 edges, but 16,000,000 paths between 400,000 pairs."""
    viewers = spark.range(400).crossJoin(spark.range(40).withColumnRenamed("id", "k")).selectExpr("id + 10000 AS followerId", "k AS followingId")
    follows = viewers.unionByName(spark.range(40).crossJoin(spark.range(1000).withColumnRenamed("id", "k")).selectExpr("id AS followerId", "k + 1000 AS followingId"))
    store, sc = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext
    stages = lambda: store.stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
    first = max([stages().apply(k).stageId() for k in range(stages().size())], default=-1)
    got = everyone.two_hops(follows, 2).collect()
    sc._jsc.sc().listenerBus().waitUntilEmpty(60_000)
    done = stages()
    sent = sum(s.shuffleWriteRecords() for s in map(done.apply, range(done.size())) if s.stageId() > first)
    assert sorted(map(tuple, got)) == sorted((v, x, 40, x - 999) for v in range(10000, 10400) for x in (1000, 1001))
    assert sent < 4 * 56_000


def test_viewers_in_steps():
    """Steps of a few paths, viewers over several rows and batches, cells one after another."""
    r = random.Random(9)
    edges = [(r.randrange(50), r.randrange(50)) for _ in range(600)]
    lists = {}
    for a, b in sorted(set(edges)):
        lists.setdefault(a, []).append(b)
    rows = [(cell, cell % 2, kind, a, b[k : k + 5]) for cell in (3, 4) for kind in (0, 1) for a, b in lists.items() for k in range(0, len(b), 5)]
    schema = pa.schema([("block", pa.int32()), ("shard", pa.int32()), ("kind", pa.int32()), ("id", pa.int64()), ("ids", pa.list_(pa.int64()))])
    for size, step in ((1, 1), (7, 30), (1000, hops.STEP)):
        batches = [pa.RecordBatch.from_pylist([dict(zip(schema.names, x, strict=True)) for x in rows[k : k + size]], schema) for k in range(0, len(rows), size)]
        got = [tuple(x.values()) for b in hops.counted(4, step)(iter(batches)) for x in b.to_pylist()]
        assert sorted(got) == sorted([x[:3] for x in plain_two_hops(edges, 4)] * 2)


@pytest.mark.parametrize("together", [2, everyone.TOGETHER])
def test_story_trays(spark, people, together):
    n, users, follows, _ = people
    r = random.Random(3)
    stories = spark.createDataFrame([(k, r.randrange(n), f"2024-01-{r.choice((14, 15))} {r.randrange(24):02d}:00:00") for k in range(80)], "storyId long, userId long, at string").withColumn("createdAt", F.col("at").cast("timestamp_ntz"))
    views = spark.createDataFrame([(r.randrange(n), r.randrange(80)) for _ in range(600)] + [(None, 1), (1, None)], "userId long, storyId long")
    got = {}
    for x in everyone.story_trays(users, follows, stories, views, "2024-01-15 12:00:00", together).collect():
        got.setdefault(x["viewer"], []).append(tuple(x)[1:])
    for v in (0, 1, 9):
        assert sorted(got.get(v, [])) == sorted(map(tuple, social.story_tray(users, follows, stories, views, v, "2024-01-15 12:00:00").collect()))


def test_no_group_holds_a_hub(spark):
    edges = spark.range(1000).select(F.col("id").alias("viewer"), F.when(F.col("id") < 900, 1).otherwise(F.col("id")).alias("author"))
    rows = spark.createDataFrame([(1, "a"), (1, "b"), (950, "c"), (5, "d")], "author long, x string")
    left, right = everyone.dealt(edges, "author", "viewer", rows, together=50)
    groups = [x["count"] for x in left.groupBy("author", "part").count().collect()]
    assert max(groups) <= 100 and sum(groups) == 1000
    assert left.join(right, ["author", "part"]).count() == edges.join(rows, "author").count() == 1801
