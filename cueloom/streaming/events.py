"""Structured Streaming forms of the windowed operators, over (key, ts, …) streams with watermarks."""

from __future__ import annotations

import math
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from ..shared import removed_at_exit, shared_dir


def read_events(spark: SparkSession, folder: str, name: str = "events.parquet") -> DataFrame:
    """A stream of a folder's event files, with ts as a timestamp; the schema is the files'."""
    schema = spark.read.parquet(f"{folder}/{name}").schema
    files = spark.readStream.schema(schema)
    stream = files.option("pathGlobFilter", name).parquet(folder)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling_counts(events: DataFrame, size: str, late: str) -> DataFrame:
    by = events.withWatermark("ts", late).groupBy(F.window("ts", size), "event_type")
    return by.agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("from"), F.col("window.end").alias("to"), "event_type", "n", "total")


def sliding_counts(events: DataFrame, size: str, step: str, late: str) -> DataFrame:
    by = events.withWatermark("ts", late).groupBy(F.window("ts", size, step))
    return by.agg(F.count("*").alias("n")).select(F.col("window.start").alias("from"), F.col("window.end").alias("to"), "n")


def session_counts(events: DataFrame, gap: str, late: str) -> DataFrame:
    by = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id")
    return by.agg(F.count("*").alias("n")).select("user_id", F.col("session_window.start").alias("from"), F.col("session_window.end").alias("to"), "n")


def first_events(events: DataFrame, late: str) -> DataFrame:
    """The stream without repeated event ids."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def with_static(events: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """Stream-static left join."""
    return events.join(table, key, "left")


class GapGroups(StatefulProcessor):
    """Groups of one key by the end-to-start rule.

    ``ahead`` is a list of the events that the watermark has not passed: new ones are appended to it, and it is read only
    when a timer says that some are due. ``group`` is the open group. A timer stands for the earliest of what is to come.
    """

    EVENT = StructType([StructField("at", DoubleType()), StructField("value", DoubleType())])
    GROUP = StructType([StructField("opened", DoubleType()), StructField("until", DoubleType()), StructField("n", LongType())])

    def __init__(self, gap: float):
        self.gap = gap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.ahead, self.group = handle, handle.getListState("ahead", self.EVENT), handle.getValueState("group", self.GROUP)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = [x for part in rows for x in zip(part["at"].tolist(), part["value"].tolist())]
        self.ahead.appendList(new)
        self.handle.registerTimer(math.ceil(min(new)[0] * 1000))
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark, done = timerValues.getCurrentWatermarkInMs() / 1000, []
        opened, until, n = self.group.get() or (None, None, 0)
        waiting = sorted((x[0], x[1]) for x in self.ahead.get())
        ready = bisect_right(waiting, (mark, math.inf))
        for at, value in waiting[:ready]:
            if n and at - until >= self.gap:
                done.append((opened, until, n))
                n = 0
            opened, until, n = (at, at + value, 1) if not n else (opened, max(until, at + value), n + 1)
        if n and until + self.gap <= mark:
            done.append((opened, until, n))
            n = 0
        if ready:
            self.ahead.put(waiting[ready:]) if waiting[ready:] else self.ahead.clear()
        self.group.update((opened, until, n)) if n else self.group.clear()
        if n or waiting[ready:]:
            self.handle.registerTimer(math.ceil(min([until + self.gap] * bool(n) + [at for at, _ in waiting[ready : ready + 1]]) * 1000))
        yield pd.DataFrame([(key[0], *d) for d in done], columns=["user_id", "opened", "until", "n"])

    def close(self) -> None:
        pass


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def gap_groups(events: DataFrame, gap: float, late: str) -> DataFrame:
    """Closed groups of each user by the end-to-start rule: a pause of ``gap`` seconds or more starts a new one.

    An event lasts ``value`` seconds. Events are held until the watermark has passed them, so those that come late, but
    not too late, are folded in their place. A group is closed by the next one, or when the watermark has passed its end
    and the gap. State is kept in RocksDB, which the session's streams use from here on.
    """
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    rows = events.withWatermark("ts", late).select("user_id", "ts", F.unix_micros("ts").cast("double").alias("micros"), "value")
    rows = rows.withColumn("at", F.col("micros") / 1e6)
    return rows.groupBy("user_id").transformWithStateInPandas(GapGroups(gap), "user_id long, opened double, until double, n long", "Append", "EventTime")


def drained(stream: DataFrame, out: str | None = None, marks: str | None = None) -> DataFrame:
    """Everything the stream gives until its input is used up, written by the query's own sink and read back.

    With folders of its own for the results (``out``) and the checkpoint (``marks``), a later call goes on from there.
    """
    spark = stream.sparkSession
    for folder in (made := [shared_dir(spark) for x in (out, marks) if x is None]):
        removed_at_exit(spark, folder)
    out, marks = out or made[0], marks or made[-1]
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", marks).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)
