"""Live activity. Each function takes a batch or a stream; late events beyond the watermark are dropped on streams."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from datetime import datetime, timezone
from threading import Lock
from typing import Any
from zoneinfo import ZoneInfo

from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType


def event_stream(spark: SparkSession, path: str, schema: str | StructType, fmt: str = "parquet", files: int = 16, names: str = "*") -> DataFrame:
    """Files that arrive in a folder, those whose names fit, as a stream."""
    return spark.readStream.schema(schema).format(fmt).option("maxFilesPerTrigger", files).option("pathGlobFilter", names).load(path)


def drained(stream: DataFrame, folder: str) -> DataFrame:
    """What a stream holds now, each event once, written to a folder and read back; run again on that folder it adds what has come since."""
    run = stream.writeStream.format("parquet").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start(f"{folder}/data")
    run.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/data")


def _marked(df: DataFrame, time: str, late: str) -> DataFrame:
    return df.withWatermark(time, late) if df.isStreaming else df


def sessions(df: DataFrame, key: str, time: str, gap: str = "20 minutes", late: str = "1 hour") -> DataFrame:
    """(key, start, end, events): activity with no pause of the gap; the end is when inactivity is known."""
    w = F.session_window(F.col(time), gap)
    return _marked(df, time, late).groupBy(w, F.col(key)).agg(F.count("*").alias("events")).select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "events")


def last_value(df: DataFrame, keys: list[str], value: str, *order: str) -> DataFrame:
    """The last value of each key by the order's columns, which should be total; a null removes it."""
    return df.groupBy(*keys).agg(F.max_by(F.struct(value), F.struct(*order)).alias("__last")).select(*keys, F.col("__last")[value].alias(value)).where(F.col(value).isNotNull())


def once(df: DataFrame, keys: list[str], time: str, late: str = "1 day") -> DataFrame:
    """One row for each key (on streams: within the watermark)."""
    return _marked(df, time, late).dropDuplicatesWithinWatermark(keys) if df.isStreaming else df.dropDuplicates(keys)


def read_receipts(messages: DataFrame, entered: DataFrame) -> DataFrame:
    """Messages marked read where another member entered the room at or after them.

    Only the last entry of any member and the last one of anybody else matter, so a room's messages meet one row.
    """
    last = entered.groupBy("roomId", "userId").agg(F.max("sentAt").alias("seen"))
    order = Window.partitionBy("roomId").orderBy(F.col("seen").desc(), "userId")
    two = last.withColumn("__n", F.row_number().over(order)).where("__n <= 2")
    two = two.groupBy(F.col("roomId").alias("__room")).agg(F.max(F.when(F.col("__n") == 1, F.struct("userId", "seen"))).alias("__a"), F.max(F.when(F.col("__n") == 2, F.col("seen"))).alias("__b"))
    df = messages.join(two, F.col("roomId") == F.col("__room"), "left")
    seen = F.when(F.col("__a.userId") != F.col("senderId"), F.col("__a.seen")).otherwise(F.col("__b"))
    return df.withColumn("isRead", F.col("isRead") | F.coalesce(seen >= F.col("sentAt"), F.lit(False))).drop("__room", "__a", "__b")


def collapsed(df: DataFrame, keys: list[str], time: str, action: str, id_: str, window: str = "500 milliseconds") -> DataFrame:
    """The last of the actions of each key in each short window, by time and id."""
    return _marked(df, time, "10 seconds").groupBy(F.window(F.col(time), window), *keys).agg(F.max_by(action, F.struct(time, id_)).alias(action)).select(*keys, F.col("window.start").alias("window_start"), action)


def with_sender(rows: DataFrame, senders: DataFrame) -> DataFrame:
    """Rows with what is known of their sender; null where nothing is."""
    return rows.join(senders, "senderId", "left")


def fan_out(stream: DataFrame, senders: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str):
    """A query that gives each micro-batch, with its sender's row, to write."""
    return stream.writeStream.foreachBatch(lambda df, k: write(with_sender(df, senders), k)).option("checkpointLocation", checkpoint).start()


class Inactivity(StatefulProcessor):
    """Emits a key once when nothing of it has come for the gap; its state then goes."""

    def __init__(self, gap_ms: int = 20 * 60 * 1000) -> None:
        self.gap_ms = gap_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "at long")

    def handleInputRows(self, key: Any, rows: Iterator[Any], timerValues: Any) -> Iterator[Row]:
        for _ in rows:
            pass
        now = timerValues.getCurrentProcessingTimeInMs()
        for old in self.handle.listTimers():
            self.handle.deleteTimer(old)
        self.last.update((now,))
        self.handle.registerTimer(now + self.gap_ms)
        return iter(())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        last = self.last.get()[0]
        self.last.clear()
        yield Row(key=str(key[0]), last=last)

    def close(self) -> None:
        pass


def inactive(stream: DataFrame, key: str, gap_ms: int = 20 * 60 * 1000) -> DataFrame:
    """(key, last): exact alerts by a timer for each key, on processing time. Needs the RocksDB state store."""
    return stream.groupBy(key).transformWithState(Inactivity(gap_ms), "key string, last long", "Append", "ProcessingTime")


@dataclass
class Job:
    """What runs at some minutes of the hour (all hours, or the named ones) in the editions' zone."""

    name: str
    minute: int
    run: Callable[[str], Any]
    hours: frozenset[int] | None = None


class Schedule:
    """Calls the jobs that are due at a time; a job that is still running is passed over, and a minute counts once.

    The clock is the caller's: ``tick`` takes the time in UTC, so a trigger, a cron line or a test may drive it.
    """

    def __init__(self, jobs: list[Job], zone: str) -> None:
        self.jobs, self.zone = jobs, ZoneInfo(zone)
        self.busy: dict[str, Lock] = {j.name: Lock() for j in jobs}
        self.done: dict[str, str] = {}

    def tick(self, now_utc: str) -> dict[str, Any]:
        """What each due job returned; jobs that run already are left out."""
        local = datetime.fromisoformat(now_utc).replace(tzinfo=timezone.utc).astimezone(self.zone)
        out, mark = {}, local.strftime("%Y-%m-%d %H:%M")
        for j in self.jobs:
            due = local.minute == j.minute and (j.hours is None or local.hour in j.hours)
            if due and self.done.get(j.name) != mark and self.busy[j.name].acquire(blocking=False):
                try:
                    self.done[j.name] = mark
                    out[j.name] = j.run(now_utc)
                finally:
                    self.busy[j.name].release()
        return out
