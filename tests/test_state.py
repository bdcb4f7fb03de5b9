"""Live state: streams come to what the batch says, with repeats, removals, disorder and restarts."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from feedloom.streaming import state

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
START = datetime(2024, 1, 1)


@pytest.fixture(scope="module", autouse=True)
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, ROCKS)
    yield
    spark.conf.set(key, before)


def run(df, folder, name, mode):
    """Everything that is there now, as one more run of the query that keeps its checkpoint in the folder."""
    q = df.writeStream.format("parquet" if mode == "append" else "noop")
    rows = []
    if mode == "append":
        q = q.option("path", f"{folder}/{name}-out")
    else:
        q = df.writeStream.foreachBatch(lambda b, k: rows.extend(b.collect()))
    q = q.outputMode(mode).option("checkpointLocation", f"{folder}/{name}").trigger(availableNow=True).start()
    assert q.awaitTermination(180)
    return df.sparkSession.read.schema(df.schema).parquet(f"{folder}/{name}-out").collect() if mode == "append" else rows


EVENTS = "user string, member string, at timestamp, id long, kind string"


def events(n=400, seed=3):
    r = random.Random(seed)
    rows = [(r.choice(["u1", "u2", "u3", "hot", "hot"]), r.choice(["a", "b", "c"]), START + timedelta(milliseconds=r.randint(0, 3000)), k, r.choice(["on", "on", "off", "off", "other"])) for k in range(n)]
    rows += r.sample(rows, 60)  # the same events again
    r.shuffle(rows)
    return rows


def plain_latest(rows):
    last = {}
    for user, member, at, id_, kind in rows:
        if (user, member) not in last or (at, id_) > last[user, member][0]:
            last[user, member] = (at, id_), kind
    return {k: v for k, (_, v) in last.items()}


def test_latest_and_online(spark, tmp_path):
    rows, folder = events(), str(tmp_path)
    value = F.when(F.col("kind") != "off", F.col("kind"))
    latest = lambda df: state.current(df, ["user"], "member", value, "at", "id")
    online = lambda df: state.online(df, "user", "member", F.col("kind") == "on", "at", "id")
    seen, there = {}, {}
    for k, part in enumerate((rows[:150], rows[150:300], rows[300:])):
        spark.createDataFrame(part, EVENTS).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(EVENTS).parquet(f"{folder}/in")
        for x in run(latest(stream), folder, "latest", "update"):
            if x["version"] > seen.get((x["key"], x["member"]), (None, 0))[1]:
                seen[x["key"], x["member"]] = x["value"], x["version"]
        for x in run(online(stream), folder, "online", "update"):
            if x["version"] > there.get(x["key"], (None, 0))[1]:
                assert x["online"] != there.get(x["key"], (False, 0))[0]
                there[x["key"]] = x["online"], x["version"]
        so_far = rows[: (150, 300, len(rows))[k]]
        held = plain_latest(so_far)
        batch = spark.createDataFrame(so_far, EVENTS)
        want = {k: v for k, v in held.items() if v != "off"}
        assert {(x["key"], x["member"]): x["value"] for x in latest(batch).collect()} == want == {k: v[0] for k, v in seen.items() if v[0] is not None}
        users = {u: any(v == "on" for (w, _), v in held.items() if w == u) for u in {u for u, _ in held}}
        assert {x["key"]: x["online"] for x in online(batch).collect()} == users == {u: there.get(u, (False,))[0] for u in users}


def test_a_socket_that_closes_twice_has_closed_once(spark):
    rows = [("u", "s1", START, 1, "on"), ("u", "s2", START, 2, "on"), ("u", "s1", START, 3, "off"), ("u", "s1", START, 4, "off"), ("v", None, START, 5, "on"), ("w", "s", None, 6, "on"), ("x", "s", START, 7, None)]
    got = state.online(spark.createDataFrame(rows, EVENTS), "user", "member", F.col("kind") == "on", "at", "id").collect()
    assert {x["key"]: x["online"] for x in got} == {"u": True, "v": True, "x": False}


ROOMS = "roomId string, userId string, at timestamp, id long, kind string"
MESSAGES = "roomId string, receiverId string, at timestamp, id long, text string"


def plain_read(messages, turns):
    out = {}
    for room, receiver, at, id_, _ in messages:
        before = [(t[2], t[3], t[4]) for t in turns if t[0] == room and t[1] == receiver and (t[2], t[3]) < (at, id_)] if at else []
        out[id_] = bool(before) and max(before)[2] == "open"
    return out


def rooms(seed=8):
    r = random.Random(seed)
    when = lambda: START + timedelta(seconds=r.randint(0, 4000), milliseconds=r.choice((0, 0, 1)))
    turns = [(r.choice("AB"), r.choice("xy"), when(), 2 * k, r.choice(["open", "open", "close"])) for k in range(120)]
    messages = [(r.choice("ABC"), r.choice("xyz"), when(), 2 * k + 1, "t") for k in range(400)]
    messages += [(t[0], t[1], t[2], 1001 + t[3] * 2 if r.random() < 0.5 else 2 * k + 100_001, "tie") for k, t in enumerate(turns)]
    return messages, turns


def test_delivered_as_read_in_batch(spark):
    messages, turns = rooms()
    turns += [("L", "x", START - timedelta(days=900), 1, "open"), ("L", "x", START + timedelta(days=3), 2, "close"), ("M", "x", START - timedelta(days=900), 3, "open"), (None, "x", START, 9, "open"), ("N", "x", None, 9, "open")]
    messages += [("L", "x", START, 5001, "t"), ("L", "x", START + timedelta(days=4), 5002, "t"), ("M", "x", START + timedelta(days=900), 5003, "t"), (None, "x", START, 5004, "t"), ("N", "x", None, 5005, "t"), ("A", None, START, 5006, "t")]
    m = spark.createDataFrame([*messages, messages[3]], MESSAGES)
    got = state.delivered_as_read(m, spark.createDataFrame(turns, ROOMS), F.col("kind") == "open").collect()
    want = plain_read(messages, [t for t in turns if t[0] and t[2]])
    assert len(got) == len(messages) + 1 and {x["id"]: x["asRead"] for x in got} == want and any(want.values())
    none = state.delivered_as_read(m, spark.createDataFrame([], ROOMS), F.col("kind") == "open").collect()
    assert len(none) == len(messages) + 1 and not any(x["asRead"] for x in none)


def test_delivered_as_read_on_streams(spark, tmp_path):
    messages, turns = rooms()
    end = START + timedelta(hours=3)
    late_close = ("A", "x", START + timedelta(seconds=2000, milliseconds=5), 5000, "close")
    parts = [([m for m in messages if m[2] < START + timedelta(seconds=s + 1000) and m[2] >= START + timedelta(seconds=s)], [t for t in turns if t[2] < START + timedelta(seconds=s + 1000) and t[2] >= START + timedelta(seconds=s)]) for s in range(0, 5000, 1000)]
    parts[2][1].append(("A", "x", START + timedelta(seconds=2000, milliseconds=1), 4998, "open"))
    parts[3][1].append(late_close)  # comes a file later than what it closes, within the watermark
    parts.append(([("Z", "z", end, 9_000_001, "end")], [("Z", "z", end, 9_000_002, "close")]))
    every, folder = sorted({t for _, ts in parts for t in ts}, key=lambda t: t[3]), str(tmp_path)
    assert len(every) == len(turns) + 3
    r = random.Random(1)
    for ms, ts in parts:
        r.shuffle(ms)
        r.shuffle(ts)
        spark.createDataFrame(ms, MESSAGES).coalesce(1).write.mode("append").parquet(f"{folder}/m")
        spark.createDataFrame(ts, ROOMS).coalesce(1).write.mode("append").parquet(f"{folder}/t")
        m, t = spark.readStream.schema(MESSAGES).parquet(f"{folder}/m"), spark.readStream.schema(ROOMS).parquet(f"{folder}/t")
        got = run(state.delivered_as_read(m, t, F.col("kind") == "open", slice_ms=90_000, late="40 minutes"), folder, "read", "append")
    got = {x["id"]: x["asRead"] for x in got}
    want = plain_read(messages, every)
    batch = state.delivered_as_read(spark.createDataFrame(messages, MESSAGES), spark.createDataFrame(every, ROOMS), F.col("kind") == "open").collect()
    assert {x["id"]: x["asRead"] for x in batch} == want
    assert {k: got.get(k) for k in want} == want and any(want.values())
