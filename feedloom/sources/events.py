"""Live events by kind: each kind's fields are typed and checked, what does not fit goes to a side table with the reason.

An event is one line of JSON: event, id, at and data, an object with the kind's fields. Files of a folder are the source, so that offsets are
the file source's: a query that starts again goes on where its checkpoint ended.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The kinds of events, their fields, and which of these must be there.
KINDS: dict[str, tuple[str, tuple[str, ...]]] = {
    "connection": ("userId long, socketId string", ("userId", "socketId")),
    "disconnect": ("userId long, socketId string", ("userId", "socketId")),
    "requestOnlineUsers": ("userId long", ()),
    "chatActivity": ("roomId string, userId long, type string", ("roomId", "userId")),
    "reactionUpdated": ("senderId long, reaction string, messageId long", ("senderId", "messageId")),
    "userOnline": ("userId long", ("userId",)),
    "userOffline": ("userId long", ("userId",)),
    "enterRoom": ("roomId string, userId long", ("roomId", "userId")),
    "openChat": ("roomId string, userId long", ("roomId", "userId")),
    "closeChat": ("roomId string, userId long", ("roomId", "userId")),
    "sendMessage": ("roomId string, UserDetails array<long>, content string, replyToMessageId long, isMedia boolean, caption string, isPost boolean", ("roomId", "UserDetails", "content")),
    "deleteMessage": ("roomId string, senderId long, receiverId long, messageId long, deleteForEveryone boolean", ("roomId", "messageId")),
}


def lines(spark: SparkSession, path: str, files: int = 16) -> DataFrame:
    """Lines of the files that arrive in a folder, as a stream."""
    return spark.readStream.format("text").option("maxFilesPerTrigger", files).load(path)


def read_events(raw: DataFrame, line: str = "value", kinds: dict[str, tuple[str, tuple[str, ...]]] = KINDS) -> DataFrame:
    """(event, id, at, data, problem, line) of each line, batch or stream: data is a struct with one struct for each kind, of which the event's own
    is filled; problem says why a line is no event, and is null for one. Blank lines are left out.

    A line must be an object with a known event, an id and a time; its data must parse with the kind's types and hold what must be there. A
    message's two people must differ.
    """
    found = raw.select(F.col(line).alias("line")).where("trim(line) <> ''")
    found = found.withColumn("__e", F.from_json("line", "event string, id long, at timestamp, data string, _bad string", {"columnNameOfCorruptRecord": "_bad"}))
    event, data = F.col("__e.event"), F.col("__e.data")
    parsed, unfit, lacking = [], F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, (fields, needed) in kinds.items():
        own = F.from_json(F.when(event == kind, F.coalesce(data, F.lit("{}"))), f"{fields}, _bad string", {"columnNameOfCorruptRecord": "_bad"})
        parsed.append(own.alias(kind))
    found = found.withColumn("__p", F.struct(*parsed))
    for kind, (_, needed) in kinds.items():
        p = F.col("__p")[kind]
        unfit = F.when((event == kind) & p["_bad"].isNotNull(), "data").otherwise(unfit)
        absent: Column = F.lit(None).cast("string")
        for n in reversed(needed):
            absent = F.when(p[n].isNull(), n).otherwise(absent)
        lacking = F.when(event == kind, absent).otherwise(lacking)
    alone = (event == "sendMessage") & ((F.size(F.col("__p")["sendMessage"]["UserDetails"]) != 2) | (F.col("__p")["sendMessage"]["UserDetails"][0] == F.col("__p")["sendMessage"]["UserDetails"][1])) if "sendMessage" in kinds else F.lit(False)
    problem = (
        F.when(F.col("__e").isNull() | F.col("__e._bad").isNotNull(), "no event")
        .when(event.isNull() | ~event.isin(*kinds), "unknown event")
        .when(F.col("__e.id").isNull() | F.col("__e.at").isNull(), "no id or time")
        .when(unfit.isNotNull(), "data")
        .when(lacking.isNotNull(), F.concat(F.lit("no "), lacking))
        .when(F.coalesce(alone, F.lit(False)), "no two people")
    )
    good = F.when(problem.isNull(), F.struct(*[F.when(event == k, F.struct(*[F.col("__p")[k][f.strip().split(" ")[0]].alias(f.strip().split(" ")[0]) for f in _fields(v[0])])).alias(k) for k, v in kinds.items()]))
    return found.select(event.alias("event"), F.col("__e.id").alias("id"), F.col("__e.at").alias("at"), good.alias("data"), problem.alias("problem"), "line")


def _fields(spec: str) -> list[str]:
    return spec.split(", ")


def of_kind(events: DataFrame, kind: str) -> DataFrame:
    """(id, at, the kind's fields) of one kind's good events."""
    return events.where((F.col("event") == kind) & F.col("problem").isNull()).select("id", "at", f"data.{kind}.*")


def sorted_out(stream: DataFrame, folder: str, once: bool = False):
    """A query that writes each micro-batch's good events below ``folder``/good, by kind, and the others with their problem to ``folder``/bad.

    A batch's files lie under its number and are overwritten when it comes again, so a restart leaves no event twice and loses none.
    """

    def write(df: DataFrame, batch: int) -> None:
        df = df.withColumn("batch", F.lit(batch))
        for part, rows, by in (("good", df.where("problem IS NULL").drop("problem", "line").withColumn("kind", F.col("event")), ["batch", "kind"]), ("bad", df.where("problem IS NOT NULL").select("event", "id", "problem", "line", "batch"), ["batch"])):
            rows.write.partitionBy(*by).option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(f"{folder}/{part}")

    q = stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{folder}/state")
    return (q.trigger(availableNow=True) if once else q).start()
