"""JDBC in balanced ranges with patience for lost connections only; live events by kind."""

import json
import random

import pytest
from pyspark.sql import functions as F

from feedloom.sources import events as ev
from feedloom.sources import tables

DERBY = {"driver": "org.apache.derby.jdbc.EmbeddedDriver"}


def test_jdbc_ranges_are_balanced(spark):
    r = random.Random(3)
    url = "jdbc:derby:memory:people;create=true"
    keys = [int(1.5 ** r.uniform(0, 40)) for _ in range(900)] + [77] * 300 + [None] * 20
    rows = [(k, f"n{i}") for i, k in enumerate(keys)]
    spark.createDataFrame(rows, "id long, name string").write.jdbc(url, "people", properties=DERBY)
    df = tables.read_jdbc(spark, url, "people", "id", 8, **DERBY)
    assert sorted(x["name"] for x in df.collect()) == sorted(n for _, n in rows)
    sizes = [x["n"] for x in df.groupBy(F.spark_partition_id().alias("p")).agg(F.count_if(F.coalesce(F.col("id"), F.lit(0)) != 77).alias("n")).collect()]
    assert len(sizes) >= 6 and max(sizes) <= 2 * 1220 / 8
    heavy = df.where("id = 77").select(F.spark_partition_id().alias("p"), "name")
    alone = df.groupBy(F.spark_partition_id().alias("p")).agg(F.count_if(F.col("id") == 77).alias("h"), F.count("*").alias("n")).where("h > 0").collect()
    assert heavy.select("p").distinct().count() == 1 and alone[0]["n"] - alone[0]["h"] <= 1220 / 8
    assert tables.read_jdbc(spark, url, "people", **DERBY).count() == len(rows)
    spark.createDataFrame([(5, "x")] * 3, "id long, name string").write.jdbc(url, "same", properties=DERBY)
    assert tables.read_jdbc(spark, url, "same", "id", 4, **DERBY).count() == 3


def test_only_lost_connections_are_tried_again(spark, monkeypatch):
    waits = []
    monkeypatch.setattr(tables, "sleep", waits.append)
    with pytest.raises(Exception):
        tables.read_jdbc(spark, "jdbc:derby:memory:people2;create=true", "nobody", attempts=3, wait=0.5, **DERBY)
    assert waits == []
    with pytest.raises(Exception):
        tables.read_jdbc(spark, "jdbc:derby://127.0.0.1:1/none", "nobody", attempts=3, wait=20.0, driver="org.apache.derby.jdbc.ClientDriver")
    tried = []

    def work():
        tried.append(1)
        if len(tried) < 4:
            spark.sparkContext._jvm.java.net.Socket("127.0.0.1", 1)
        return "there"

    waits.clear()
    assert tables.patiently(work, attempts=5, wait=10.0) == "there" and waits == [10.0, 20.0, 30.0]


def line(event, id_, data, at="2024-01-01T00:00:00"):
    return json.dumps({"event": event, "id": id_, "at": at, "data": data})


GOOD = [
    line("connection", 1, {"userId": 5, "socketId": "s"}),
    line("openChat", 2, {"roomId": "1_2", "userId": 1, "extra": [1]}),
    line("sendMessage", 3, {"roomId": "1_2", "UserDetails": [1, 2], "content": "hello", "isMedia": False}),
    line("reactionUpdated", 4, {"senderId": 1, "reaction": None, "messageId": 9}),
    line("requestOnlineUsers", 5, None),
    line("deleteMessage", 6, {"roomId": "1_2", "messageId": 9, "deleteForEveryone": True}),
]
BAD = {"{broken": "no event", "[1]": "no event", line("dance", 7, {}): "unknown event", json.dumps({"id": 1}): "unknown event", line("openChat", None, {"roomId": "a", "userId": 1}): "no id or time", line("openChat", 8, {"roomId": "a"}): "no userId", line("openChat", 9, {"roomId": "a", "userId": "you"}): "data", line("sendMessage", 10, {"roomId": "a", "UserDetails": [1, 1], "content": "x"}): "no two people", line("openChat", 11, None): "no roomId"}


def test_events_by_kind(spark):
    raw = spark.createDataFrame([(x,) for x in [*GOOD, *BAD, "", "  "]] + [(None,)], "value string")
    got = ev.read_events(raw)
    bad = {x["line"]: x["problem"] for x in got.where("problem IS NOT NULL").collect()}
    assert bad == BAD
    assert sorted(x["id"] for x in got.where("problem IS NULL").collect()) == [1, 2, 3, 4, 5, 6]
    m = ev.of_kind(got, "sendMessage").collect()
    assert [(x["roomId"], x["UserDetails"], x["content"], x["isMedia"], x["caption"]) for x in m] == [("1_2", [1, 2], "hello", False, None)]
    assert all(set(ev.of_kind(got, k).columns) == {"id", "at", *(f.split(" ")[0] for f in spec.split(", "))} for k, (spec, _) in ev.KINDS.items())


def test_a_restart_goes_on_where_it_ended(spark, tmp_path):
    folder = f"{tmp_path}/out"
    every = [line("userOnline", k, {"userId": k}) if k % 7 else "{bad" + str(k) for k in range(60)]
    for a in range(0, 60, 20):
        spark.createDataFrame([(x,) for x in every[a : a + 20]], "value string").repartition(2).write.mode("append").text(f"{tmp_path}/in")
        q = ev.sorted_out(ev.read_events(ev.lines(spark, f"{tmp_path}/in", files=1)), folder, once=True)
        assert q.awaitTermination(120)
    good, bad = spark.read.parquet(f"{folder}/good"), spark.read.parquet(f"{folder}/bad")
    assert sorted(x["id"] for x in good.collect()) == [k for k in range(60) if k % 7]
    assert sorted(x["line"] for x in bad.collect()) == sorted(x for x in every if x.startswith("{bad"))
    batch = ev.read_events(spark.createDataFrame([(x,) for x in every], "value string"))
    assert sorted(x["id"] for x in ev.of_kind(batch, "userOnline").collect()) == sorted(x["id"] for x in good.where("kind = 'userOnline'").collect())
