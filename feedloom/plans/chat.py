"""Chat: last activity, recent rooms, message pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import relational as rel


def last_activity(messages: DataFrame, reactions: DataFrame) -> DataFrame:
    """(roomId, kind, id, sentAt): the latest message if it is unread, else the newest unread reaction, else whichever of the
    newest reaction and the message is later. Rooms without a message have none."""
    pick = lambda df, p: df.groupBy(F.col("roomId").alias(f"__{p}")).agg(F.max(F.struct("sentAt", "id")).alias(p))
    m = messages.groupBy("roomId").agg(F.max(F.struct("sentAt", "id", "isRead")).alias("m"))
    unread, newest = pick(reactions.where(~F.col("isRead")), "u"), pick(reactions, "r")
    df = m.join(unread, F.col("roomId") == F.col("__u"), "left").join(newest, F.col("roomId") == F.col("__r"), "left")
    own = F.struct(F.lit("message").alias("kind"), F.col("m.id").alias("id"), F.col("m.sentAt").alias("sentAt"))
    react = lambda c: F.struct(F.lit("reaction").alias("kind"), F.col(f"{c}.id").alias("id"), F.col(f"{c}.sentAt").alias("sentAt"))
    found = F.when(~F.col("m.isRead"), own).when(F.col("u").isNotNull(), react("u")).when(F.col("r.sentAt") > F.col("m.sentAt"), react("r")).otherwise(own)
    return df.select("roomId", found.alias("f")).select("roomId", "f.kind", "f.id", "f.sentAt")


def recent_rooms(messages: DataFrame, reactions: DataFrame, cursor: tuple | None = None, first: int = 20, later: int = 12) -> DataFrame:
    """Rooms by last activity, newest first: 20, then 12 after a cursor of (sentAt, roomId)."""
    return rel.before(last_activity(messages, reactions), "sentAt", "roomId", cursor, first if cursor is None else later)


def message_page(messages: DataFrame, reactions: DataFrame, room: int, viewer: str, cursor: tuple | None = None, n: int = 20) -> DataFrame:
    """The newest n visible messages before the cursor, oldest first, with reactions and the quoted message."""
    page = rel.before(rel.visible(messages.where(F.col("roomId") == room), viewer), "sentAt", "id", cursor, n)
    marks = reactions.groupBy(F.col("messageId").alias("__m")).agg(F.count("*").alias("reactions"))
    quoted = messages.select(F.col("id").alias("__q"), F.col("senderId").alias("quotedSender"))
    page = page.join(marks, F.col("id") == F.col("__m"), "left").join(quoted, F.col("replyTo") == F.col("__q"), "left")
    return page.select("id", "senderId", "sentAt", F.coalesce("reactions", F.lit(0)).alias("reactions"), "replyTo", "quotedSender").orderBy("sentAt", "id")


def mark_read(messages: DataFrame, room: int, reader: str) -> DataFrame:
    """Messages with those that others sent to the room marked read."""
    return messages.withColumn("isRead", F.when((F.col("roomId") == room) & (F.col("senderId") != reader), True).otherwise(F.col("isRead")))
