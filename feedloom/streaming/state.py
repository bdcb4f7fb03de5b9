"""State with removal, and viewings of rooms: each as a batch and as a stream that comes to the same.

An event counts by its time, in milliseconds, and its id; whatever order events arrive in, and however often, the state is the same.
The streams' state is in maps (RocksDB state store); rows reach Python in Arrow batches.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Cells of the grid by which viewings meet messages, in milliseconds: the smallest, and how many of one are in the next.
CELL, FACTOR, LEVELS = 3600 * 1000, 8, 8


def millis(time: Column) -> Column:
    return F.unix_millis(time.cast("timestamp"))


# ---- the last value of every member of a key


class Latest(StatefulProcessor):
    """For each member of a key its last value by (at, id); emits a member's row when its value changes, null for a removal.

    A removed member is forgotten when the watermark has passed its removal, since nothing older can come then.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getMapState("held", "member string", "at long, id long, value string")
        self.count = handle.getValueState("count", "n long")

    def changes(self, rows: Iterator[pd.DataFrame]) -> dict[str, tuple]:
        """Applies rows to the state; members whose value is another now."""
        newest: dict[str, tuple] = {}
        for df in rows:
            for member, at, id_, value in zip(df["member"], df["at"], df["id"], df["value"], strict=True):
                now = (int(at), int(id_), None if pd.isna(value) else value)
                if member not in newest or now[:2] > newest[member][:2]:
                    newest[member] = now
        out = {}
        for member, now in newest.items():
            old = self.held.getValue((member,)) if self.held.containsKey((member,)) else None
            if old is None or now[:2] > tuple(old)[:2]:
                self.held.updateValue((member,), now)
                if now[2] is None:
                    self.handle.registerTimer(now[0] + 1)
                if now[2] != (old[2] if old is not None else None):
                    out[member] = now
        return out

    def version(self, n: int) -> int:
        """Numbers n changes of the key; the number before the first."""
        found = self.count.get()[0] if self.count.exists() else 0
        self.count.update((found + n,))
        return found

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        out = self.changes(rows)
        if out:
            first = self.version(len(out)) + 1
            yield pd.DataFrame({"key": [str(key[0])] * len(out), "member": list(out), "value": [x[2] for x in out.values()], "version": range(first, first + len(out))})

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        for member, (at, _, value) in [(k[0], tuple(v)) for k, v in self.held.iterator()]:
            if value is None and at < now:
                self.held.removeKey((member,))
        return iter(())

    def close(self) -> None:
        pass


class Online(Latest):
    """Emits a key when its first member opens and when its last one closes; a member with a value is open."""

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        changed = self.changes(rows)
        if changed:
            # what changed in this batch, taken back, gives how many were open before it
            open_now = sum(v[2] is not None for _, v in self.held.iterator())
            shut = sum(x[2] is None for x in changed.values())
            before = open_now - (len(changed) - shut) + shut
            if (before > 0) != (open_now > 0):
                yield pd.DataFrame({"key": [str(key[0])], "online": [open_now > 0], "version": [self.version(1) + 1]})


def _events(df: DataFrame, key: list[str], member: str, value: Column, time: str, id_: str, late: str) -> DataFrame:
    joined = F.concat_ws("\u0001", *[F.coalesce(F.col(k).cast("string"), F.lit("\u0000")) for k in key])
    out = df.select(joined.alias("key"), F.coalesce(F.col(member).cast("string"), F.lit("")).alias("member"), millis(F.col(time)).alias("at"), F.col(id_).cast("long").alias("id"), value.cast("string").alias("value"), F.col(time).cast("timestamp").alias("eventTime")).where("at IS NOT NULL AND id IS NOT NULL")
    return out.withWatermark("eventTime", late) if df.isStreaming else out


def current(df: DataFrame, key: list[str], member: str, value: Column, time: str, id_: str, late: str = "1 hour") -> DataFrame:
    """(key, member, value): each member's last value by time and id, a null removes it. Parts of a key are joined by a control character.

    Of a stream, changes with a version by which the last one of a member is known; events later than the watermark don't count. Rows
    without time or id don't count.
    """
    events = _events(df, key, member, value, time, id_, late)
    if df.isStreaming:
        return events.groupBy("key").transformWithStateInPandas(Latest(), "key string, member string, value string, version long", "Update", "EventTime")
    last = events.groupBy("key", "member").agg(F.max_by(F.struct("value"), F.struct("at", "id")).alias("x"))
    return last.select("key", "member", "x.value").where("value IS NOT NULL")


def online(df: DataFrame, user: str, socket: str, opens: Column, time: str, id_: str, late: str = "1 hour") -> DataFrame:
    """(key, online): whether a user has a socket whose last event opened it; a socket that closes twice has closed once.

    Of a stream, the users that come online or go, with a version.
    """
    events = _events(df, [user], socket, F.when(F.coalesce(opens, F.lit(False)), F.lit("open")), time, id_, late)
    if df.isStreaming:
        return events.groupBy("key").transformWithStateInPandas(Online(), "key string, online boolean, version long", "Update", "EventTime")
    last = events.groupBy("key", "member").agg(F.max_by(F.struct("value"), F.struct("at", "id")).alias("x"))
    return last.groupBy("key").agg(F.bool_or(F.col("x.value").isNotNull()).alias("online"))


# ---- messages that find their receiver in the room


class Viewings(StatefulProcessor):
    """From opens and closes of a room by a user, in order once the watermark has passed them, spells of viewing of at most slice_ms; a longer one comes in several."""

    def __init__(self, slice_ms: int) -> None:
        self.slice_ms = slice_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "at long, id long", "open boolean")
        self.opened = handle.getValueState("opened", "at long, id long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        for df in rows:
            for at, id_, opens in zip(df["ms"], df["id"], df["opens"], strict=True):
                self.waiting.updateValue((int(at), int(id_)), (bool(opens),))
                self.handle.registerTimer(int(at) - 1)
        return iter(())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        spells = []
        since = tuple(self.opened.get()) if self.opened.exists() else None
        for at, id_ in sorted(tuple(k) for k in self.waiting.keys()):
            if at > now:
                self.handle.registerTimer(at - 1)
                break
            opens = self.waiting.getValue((at, id_))[0]
            self.waiting.removeKey((at, id_))
            since = self._until(since, at, spells)
            if opens and since is None:
                since = (at, id_)
            elif not opens and since is not None:
                spells.append((*since, at, id_))
                since = None
        since = self._until(since, now, spells)
        if since is None:
            self.opened.clear()
        else:
            self.opened.update(since)
            self.handle.registerTimer(since[0] + self.slice_ms - 1)
        if spells:
            time = lambda k: pd.to_datetime([s[k] for s in spells], unit="ms", utc=True)
            yield pd.DataFrame({"viewedRoom": [str(key[0])] * len(spells), "viewer": [str(key[1])] * len(spells), "opened": time(0), "openedId": [s[1] for s in spells], "closed": time(2), "closedId": [s[3] for s in spells]})

    def _until(self, since: tuple | None, at: int, spells: list) -> tuple | None:
        """Cuts off whole slices that ended before a moment."""
        while since is not None and since[0] + self.slice_ms <= at:
            cut = since[0] + self.slice_ms
            spells.append((*since, cut, -1))
            since = (cut, -1)
        return since

    def close(self) -> None:
        pass


def viewings(events: DataFrame, opens: Column, room: str = "roomId", user: str = "userId", time: str = "at", id_: str = "id") -> DataFrame:
    """(viewedRoom, viewer, opened, openedId, closed, closedId): spells between an open and the next close, in milliseconds; the last two are null while it lasts."""
    by = Window.partitionBy("viewedRoom", "viewer").orderBy("opened", "openedId")
    e = events.select(F.col(room).cast("string").alias("viewedRoom"), F.col(user).cast("string").alias("viewer"), millis(F.col(time)).alias("opened"), F.col(id_).cast("long").alias("openedId"), F.coalesce(opens, F.lit(False)).alias("opens"))
    e = e.where("viewedRoom IS NOT NULL AND viewer IS NOT NULL AND opened IS NOT NULL AND openedId IS NOT NULL")
    turns = e.withColumn("__before", F.lag("opens").over(by)).where(F.col("opens") != F.coalesce("__before", F.lit(False)))
    turns = turns.withColumns({"closed": F.lead("opened").over(by), "closedId": F.lead("openedId").over(by)})
    return turns.where("opens").select("viewedRoom", "viewer", "opened", "openedId", "closed", "closedId")


def delivered_as_read(messages: DataFrame, events: DataFrame, opens: Column, room: str = "roomId", receiver: str = "receiverId", user: str = "userId", time: str = "at", id_: str = "id", slice_ms: int = 10 * 60 * 1000, late: str = "1 minute") -> DataFrame:
    """messages with ``asRead``: whether the receiver was viewing the room when it came, by time in milliseconds, at one time by id.

    Batch: spells meet messages by an equi-join on (room, user, cell), where a spell takes the size of cell of which it touches at most two, and
    a message looks into one cell of each size that occurs. Stream: spells in slices are joined to messages by time, both with a watermark; a
    message that was viewed comes out with its slice, another one when no slice can cover it any more. Events later than the watermark don't count.
    Ids are not negative; a message without room, receiver or time is unread.
    """
    if messages.isStreaming:
        e = events.select(F.col(room).cast("string").alias("viewedRoom"), F.col(user).cast("string").alias("viewer"), F.date_trunc("MILLISECOND", F.col(time).cast("timestamp")).alias("eventTime"), millis(F.col(time)).alias("ms"), F.col(id_).cast("long").alias("id"), F.coalesce(opens, F.lit(False)).alias("opens"))
        e = e.where("viewedRoom IS NOT NULL AND viewer IS NOT NULL AND ms IS NOT NULL AND id IS NOT NULL").withWatermark("eventTime", late)
        schema = "viewedRoom string, viewer string, opened timestamp, openedId long, closed timestamp, closedId long"
        spells = e.groupBy("viewedRoom", "viewer").transformWithStateInPandas(Viewings(slice_ms), schema, "Append", "EventTime", eventTimeColumnName="closed")
        m = messages.withColumn("__at", F.date_trunc("MILLISECOND", F.col(time).cast("timestamp"))).withWatermark("__at", late)
        inside = (F.col("__at") >= F.col("opened")) & (F.col("__at") <= F.col("closed")) & (F.col("closed") <= F.col("__at") + F.expr(f"INTERVAL {slice_ms} MILLISECONDS"))
        ties = ((F.col("__at") > F.col("opened")) | (F.col(id_) > F.col("openedId"))) & ((F.col("__at") < F.col("closed")) | (F.col(id_) < F.col("closedId")))
        out = m.join(spells, (F.col(room).cast("string") == F.col("viewedRoom")) & (F.col(receiver).cast("string") == F.col("viewer")) & inside & ties, "left")
        return out.withColumn("asRead", F.col("viewer").isNotNull()).drop("__at", "viewedRoom", "viewer", "opened", "openedId", "closed", "closedId")
    size = F.coalesce(F.col("closed") - F.col("opened"), F.lit(CELL * FACTOR**LEVELS))
    level = F.least(F.greatest(F.ceil(F.log(F.greatest(size, F.lit(1)) / CELL) / F.log(F.lit(float(FACTOR)))), F.lit(0)), F.lit(LEVELS)).cast("int")
    spells = viewings(events, opens, room, user, time, id_).withColumn("__level", level)
    cell = lambda at, lv: F.floor(at / (F.lit(CELL) * F.pow(F.lit(float(FACTOR)), lv))).cast("long")
    last = F.when(F.col("closed").isNull() | (F.col("__level") == LEVELS), cell(F.col("opened"), F.col("__level")) + 1).otherwise(cell(F.col("closed"), F.col("__level")))
    spells = spells.withColumn("__cell", F.explode(F.sequence(cell(F.col("opened"), F.col("__level")), last)))
    sizes = [r[0] for r in spells.select("__level").distinct().collect()]
    m = messages.withColumn("__at", millis(F.col(time)))
    looks = m.select("__at", F.col(room).cast("string").alias("__room"), F.col(receiver).cast("string").alias("__receiver"), F.col(id_).cast("long").alias("__id")).distinct()
    looks = looks.withColumn("__l", F.explode(F.array(*[F.lit(x) for x in sizes]) if sizes else F.array().cast("array<int>"))).withColumn("__c", cell(F.col("__at"), F.col("__l")))
    within = (F.struct("opened", "openedId") < F.struct("__at", "__id")) & (F.col("closed").isNull() | (F.struct("__at", "__id") < F.struct("closed", "closedId")))
    hit = looks.join(spells, (F.col("__room") == F.col("viewedRoom")) & (F.col("__receiver") == F.col("viewer")) & (F.col("__l") == F.col("__level")) & (F.col("__c") == F.col("__cell")) & within)
    hit = hit.select(F.col("__room").alias("__r"), F.col("__receiver").alias("__u"), F.col("__at").alias("__t"), F.col("__id").alias("__i")).distinct()
    out = m.join(hit, (F.col(room).cast("string") == F.col("__r")) & (F.col(receiver).cast("string") == F.col("__u")) & (F.col("__at") == F.col("__t")) & (F.col(id_).cast("long") == F.col("__i")), "left")
    return out.withColumn("asRead", F.col("__r").isNotNull()).drop("__at", "__r", "__u", "__t", "__i")
