"""Closures, bucketed changes and counters kept up to date, against plain Python and whole rewrites."""

import random

import pytest
from pyspark.sql import functions as F

from feedloom.operators import buckets, closure, counters, dml
from feedloom.streaming import activity


def plain_closure(parents):
    out = set()
    for node in parents:
        at, depth = parents[node], 1
        while at is not None:
            out.add((at, node, depth))
            at, depth = parents.get(at), depth + 1
    return out


def test_closure_of_deep_links(spark):
    r = random.Random(1)
    parents = {k: k - 1 for k in range(1, 40)} | {k: r.choice([None, *range(k)]) for k in range(40, 200)}
    rows = [(k, p) for k, p in parents.items()] + [(5, 4), (None, 3)]
    got = [tuple(x) for x in closure.closure(spark.createDataFrame(rows, "id long, parentId long")).collect()]
    assert len(got) == len(set(got)) and set(got) == plain_closure(parents) and max(d for _, _, d in got) > 30
    none = spark.createDataFrame([], "id long, parentId long")
    assert closure.closure(none).count() == 0


@pytest.mark.parametrize("length", [1, 2, 3, 7, 8])
def test_circles_are_refused(spark, length):
    rows = [(k, (k + 1) % length) for k in range(length)] + [(100, 0)]
    with pytest.raises(ValueError, match="circle"):
        closure.closure(spark.createDataFrame(rows, "id long, parentId long"))


def test_new_nodes_are_attached(spark):
    parents = {k: (k - 1) // 2 for k in range(1, 60)}
    old, new = {k: p for k, p in parents.items() if k < 20}, {k: p for k, p in parents.items() if k >= 20}
    held = plain_closure(old) | {(k, k, 0) for k in range(20)}
    relations = spark.createDataFrame(sorted(held), "ancestorId long, descendantId long, depth int")
    got = [tuple(x) for x in closure.attached(relations, spark.createDataFrame(list(new.items()), "id long, parentId long")).collect()]
    assert len(got) == len(set(got)) and set(got) == plain_closure(parents) | {(k, k, 0) for k in range(60)}


def test_a_post_goes_with_all_that_hangs_on_it(spark):
    posts = spark.createDataFrame([(1, 7, True), (2, 7, False), (3, 8, True), (4, None, True)], "id long, authorId long, gone boolean")
    users = spark.createDataFrame([(7, 2), (8, 5), (9, 0)], "id long, posts long")
    relations = spark.createDataFrame([(1, 2, 1), (2, 3, 1), (2, 2, 0), (5, 2, 1)], "ancestorId long, descendantId long, depth int")
    table = spark.createDataFrame([(1,), (2,), (2,), (None,), (99,)], "postId long")
    out = closure.delete_posts(posts, F.col("gone"), users, relations, {"likes": table, "mentions": table})
    assert [r["id"] for r in out["posts"].collect()] == [2]
    assert {r["id"]: r["posts"] for r in out["users"].collect()} == {7: 1, 8: 4, 9: 0}
    assert sorted(tuple(r) for r in out["relations"].collect()) == [(2, 2, 0), (5, 2, 1)]
    assert all(sorted((r["postId"] is None, r["postId"] or 0) for r in out[n].collect()) == [(False, 2), (False, 2), (False, 99), (True, 0)] for n in ("likes", "mentions"))


TABLE = "k long, g string, v string, at long"


def test_bucketed_upserts_equal_whole_ones_and_touch_little(spark, tmp_path):
    r, folder = random.Random(4), f"file://{tmp_path}/t"
    rows = lambda n: [(r.choice([None, *range(60)]), r.choice("ab"), r.choice([None, "x", "y", "z"]), k) for k in range(n)]
    schema = spark.createDataFrame([], TABLE).schema
    whole = spark.createDataFrame([], TABLE)
    assert buckets.table(spark, folder, schema).count() == 0
    for n in (80, 3, 0, 40, 1):
        new = spark.createDataFrame(rows(n), TABLE)
        touched = buckets.upsert(new, folder, schema, ["k", "g"], order=[F.desc("at")], buckets=32)
        whole = spark.createDataFrame(dml.upsert(whole, new, ["k", "g"], order=[F.desc("at")]).collect(), TABLE)
        key = lambda x: tuple((v is None, v or 0) for v in x)
        held = buckets.table(spark, folder, schema)
        assert sorted(map(tuple, held.collect()), key=key) == sorted(map(tuple, whole.collect()), key=key)
        assert len(touched) <= min(n, 32)
    one = spark.createDataFrame([(5, "a", "new", 999)], TABLE)
    before = set(buckets.table(spark, folder, schema).inputFiles())
    assert len(buckets.upsert(one, folder, schema, ["k", "g"], update=["v"], buckets=32)) == 1
    changed = set(buckets.table(spark, folder, schema).inputFiles()) - before
    assert {f.split("__bucket=")[1].split("/")[0] for f in changed} and len({f.split("__bucket=")[1].split("/")[0] for f in changed}) == 1
    assert buckets.tidy(spark, folder, keep=1) > 0 and buckets.tidy(spark, folder, keep=1) == 0


def test_a_change_that_comes_again_changes_nothing(spark, tmp_path):
    folder, schema = f"file://{tmp_path}/t", spark.createDataFrame([], "k long, n long").schema
    delta = lambda rows: spark.createDataFrame(rows, "k long, n long")
    merge = counters.added(["k"], ["n"])
    held = lambda: sorted(map(tuple, buckets.table(spark, folder, schema).collect()))
    buckets.change(delta([(k, 1) for k in range(20)]), folder, schema, ["k"], merge, 4, version=1)
    for _ in range(3):
        buckets.change(delta([(1, 5), (2, -1)]), folder, schema, ["k"], merge, 4, version=2)
        assert held() == sorted([(1, 6)] + [(k, 1) for k in range(20) if k not in (1, 2)])
    buckets.change(delta([(k, -1) for k in range(20)]), folder, schema, ["k"], merge, 4, version=3)
    assert held() == [(1, 5), (2, -1)]


def test_counters_kept_up_to_date_equal_derived_ones(spark, tmp_path):
    r, folder = random.Random(6), f"file://{tmp_path}"
    kinds = ["read", "liked", "saved", "shared", "other"]
    live, events = [], []
    for k in range(400):
        if live and r.random() < 0.3:
            gone = live.pop(r.randrange(len(live)))
            events.append((k, *gone, -1))
        else:
            live.append((r.choice([None, 0, 0, 0, *range(12)]), r.choice(kinds)))
            events.append((k, *live[-1], 1))
    spec = "id long, postId long, interactionType string, sign int"
    schema = spark.createDataFrame([], counters.POST_SUMS).schema
    for a in range(0, 400, 100):
        spark.createDataFrame(events[a : a + 100], spec).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        stream = activity.event_stream(spark, f"{folder}/in", spec, files=1)
        q = counters.maintained(stream, lambda df: counters.post_deltas(df, F.col("sign")), f"{folder}/sums", schema, ["postId"], f"{folder}/state", in_buckets=4, once=True)
        assert q.awaitTermination(120)
    want = {}
    for post, kind in live:
        if post is not None and kind != "other":
            want.setdefault(post, [0] * 4)[kinds.index(kind)] += 1
    got = {x["postId"]: [x["views"], x["likes"], x["bookmarks"], x["shared"]] for x in buckets.table(spark, f"{folder}/sums", schema).collect()}
    assert got == want


def test_threads_go_with_their_root(spark, tmp_path):
    folder, schema = f"file://{tmp_path}/t", spark.createDataFrame([], counters.THREAD_SUMS).schema
    spec, merge = "id long, parentId long, postId long, sign int", counters.added(["postId", "root"], ["own", "replies"])
    first = [(1, None, 9, 1), (2, 1, 9, 1), (3, 1, 9, 1), (4, None, 9, 1), (5, 4, 9, 1), (6, None, 8, 1)]
    second = [(1, None, 9, -1), (5, 4, 9, -1), (6, None, 8, -1), (7, None, 7, 1)]
    for version, rows in ((1, first), (2, second), (2, second)):
        buckets.change(counters.thread_deltas(spark.createDataFrame(rows, spec), F.col("sign")).groupBy("postId", "root").agg(F.sum("own").alias("own"), F.sum("replies").alias("replies")), folder, schema, ["postId", "root"], merge, 4, version)
    assert {x["postId"]: (x["comments"], x["roots"]) for x in counters.thread_counts(buckets.table(spark, folder, schema)).collect()} == {9: (1, 1), 7: (1, 1)}
