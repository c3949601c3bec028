"""Streaming forms: crawl history as keyed state, and merging of arriving actions."""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..operators import merge as merging
from ..operators import tops
from ..operators.history import DEPTH
from ..sources.snapshots import Segments, exists
from ..sources.versions import Table

EVENTS = "key long, ts timestamp, action string"
OUT = "key long, found_time timestamp, latest_success timestamp, latest_failed timestamp, events long, last_action string"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class History(StatefulProcessor):
    """The history of a key: its newest events as a list, its first and latest times as a value, and a timer for idle keys.

    Events come in any order; the list holds the newest ``DEPTH``, newest first,
    of equal times the one that came last. A key without events for ``idle``
    milliseconds is forgotten. Times are microseconds, which read alike in rows
    and in state.
    """

    def __init__(self, idle: int | None = None):
        self.idle = idle

    def init(self, handle) -> None:
        self.handle = handle
        self.newest = handle.getListState("newest", "ts long, action string")
        self.ends = handle.getValueState("ends", "found_time long, latest_success long, latest_failed long")

    def handleInputRows(self, key, rows: Iterator[Row], timer_values) -> Iterator[Row]:
        found, good, bad = self.ends.get() if self.ends.exists() else (None, None, None)
        events = list(self.newest.get()) if self.newest.exists() else []
        # the oldest first; of equal times the one that came first, so that it leaves first
        newest = [(t, -i, a) for i, (t, a) in enumerate(events)]
        heapq.heapify(newest)
        for n, r in enumerate(rows, 1):
            ts, action = r["ts"], r["action"]
            if ts is None:
                continue
            found = ts if found is None or ts < found else found
            good = ts if action == "Success" and (good is None or ts > good) else good
            bad = ts if action == "Failed" and (bad is None or ts > bad) else bad
            if action is not None and action != "None":
                # a batch may be long: never more than the newest are held
                (heapq.heappush if len(newest) < DEPTH else heapq.heappushpop)(newest, (ts, n, action))
        events = [(t, a) for t, _, a in sorted(newest, reverse=True)]
        self.ends.update((found, good, bad))
        if events:
            self.newest.put(events)
        if self.idle is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(timer_values.getCurrentProcessingTimeInMs() + self.idle)
        yield Row(key=key[0], found_time=found, latest_success=good, latest_failed=bad, events=len(events), last_action=events[0][1] if events else None)

    def handleExpiredTimer(self, key, timer_values, expired) -> Iterator[Row]:
        self.newest.clear()
        self.ends.clear()
        return iter([])

    def close(self) -> None:
        pass


def history(events: DataFrame, idle_seconds: float | None = None) -> DataFrame:
    """The history record of each key that got events; the newest ten events are its state, newest first.

    With ``idle_seconds``, keys without events for so long are forgotten; as
    timers keep asking for batches without data, such a stream ends only when it
    is stopped. Without, there are no timers, and it ends with its input. State
    is kept in RocksDB, which the session is set to.
    """
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    idle = None if idle_seconds is None else int(idle_seconds * 1000)
    timed = events.withColumn("ts", F.unix_micros("ts")).groupBy("key")
    rows = timed.transformWithState(statefulProcessor=History(idle), outputStructType=OUT.replace("timestamp", "long"), outputMode="Update", timeMode="None" if idle is None else "ProcessingTime")
    return rows.withColumns({c: F.timestamp_micros(c) for c in ("found_time", "latest_success", "latest_failed")})


def windowed_counts(events: DataFrame, size: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Events of each action by time window; rows later than ``late`` are left out."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", size), "action").agg(F.count("*").alias("n"))


def merge_actions(actions: DataFrame, table: Table, checkpoint: str):
    """Merges each batch of arriving actions into the stored documents (package, last_updated, ...), a version for each batch.

    Only buckets that a batch touches are written anew; a batch that is run
    again after a crash counts once.
    """
    payload = [c for c in table.schema.names if c not in ("package", "last_updated")]

    def merge(rows: DataFrame, changes: DataFrame) -> DataFrame:
        both = rows.withColumn("action", F.lit("original")).unionByName(changes.select(*rows.columns, "action"))
        return merging.live(merging.merge(both, *payload)).select(table.schema.names)

    def one(batch: DataFrame, n: int) -> None:
        table.change(batch, merge, mark=(checkpoint, n))

    return actions.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True)


def drain_segments(spark: SparkSession, root: str, table: Table, entries: Callable[[DataFrame], DataFrame], checkpoint: str):
    """Takes the packages of announced segments into ``table``, then removes the segments.

    ``entries`` makes rows of the table from (package). A package that the table
    has stays as it is. The version tells which batches it has, so a segment
    counts once, wherever the stream is stopped and started again.
    """

    def merge(rows: DataFrame, changes: DataFrame) -> DataFrame:
        return rows.unionByName(changes.join(rows.select(table.key), table.key, "left_anti").select(rows.columns))

    def one(batch: DataFrame, n: int) -> None:
        segments = Segments(spark, root)
        names = sorted({r["segment"] for r in batch.select("segment").collect()})  # segments, not packages
        there = [f"{root}/{x}/packages" for x in names if exists(spark, f"{root}/{x}/packages")]
        if there:
            found = entries(spark.read.schema("package string").json(there)).select(table.schema.names).dropDuplicates([table.key])
            table.change(found, merge, mark=(checkpoint, n))
        for x in names:
            segments.remove(x)

    names = spark.readStream.schema("segment string").json(Segments(spark, root).inbox)
    return names.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True)


def flush_metrics(metrics: DataFrame, path: str, checkpoint: str, seconds: int = 60):
    """Every so often, the metrics (name, method, value) that came in since, reduced by their method, go to ``path``."""

    def one(batch: DataFrame, n: int) -> None:
        tops.rollup(batch).withColumn("flush", F.lit(n)).write.mode("append").parquet(path)

    return metrics.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(processingTime=f"{seconds} seconds")


def until(running, seconds: float) -> bool:
    """Waits for a streaming query to end, at most so long; then it is stopped. Whether it ended by itself."""
    ended = running.awaitTermination(seconds)
    if not ended:
        running.stop()
    return bool(ended)


def rounds(stages: list, more) -> int:
    """Runs the stages one after another as long as ``more()`` says so. Number of rounds."""
    n = 0
    while more():
        for stage in stages:
            stage()
        n += 1
    return n


def newest_segment(engine, seconds: int = 30):
    """A rate stream that makes ``engine`` look for a newer segment every so often."""
    ticks = engine.spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    return ticks.writeStream.foreachBatch(lambda _df, _n: engine.reload()).trigger(processingTime=f"{seconds} seconds")
