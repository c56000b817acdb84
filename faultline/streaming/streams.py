"""Structured Streaming versions of the repeated polls."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from faultline import schemas
from faultline.operators.dedup import with_keys
from faultline.sources.io import FingerprintStore, flatten_log_events, new_folder


PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def state_in_rocksdb(spark: SparkSession) -> Iterator[None]:
    """Queries that are started inside keep their state in RocksDB, on disk; timers need it."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.unset(PROVIDER) if before is None else spark.conf.set(PROVIDER, before)


def drained(stream: DataFrame) -> DataFrame:
    """What a stream gives for the files that are there now: appended to a table in the shared folder, which is read again."""
    spark = stream.sparkSession
    folder = new_folder(spark, "stream")
    sink = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{folder}/state").option("path", f"{folder}/rows")
    with state_in_rocksdb(spark):
        query = sink.trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows")


def stream_logs(spark: SparkSession, path: str, env: str = "prod", files_per_trigger: int = 1000) -> DataFrame:
    """New files of log events as flat logs. Start with trigger(availableNow=True) to take what is there and stop."""
    return flatten_log_events(spark.readStream.schema(schemas.LOG_EVENTS).option("maxFilesPerTrigger", files_per_trigger).json(path), env)


def stream_first_seen(logs: DataFrame, hours: int) -> DataFrame:
    """The first log of each key; a key is forgotten `hours` after it was seen, and rows later than that are dropped."""
    keyed = with_keys(logs).withColumn("_key", F.sha1("log_key"))  # the state holds hashes, not whole messages
    return keyed.withWatermark("ts", f"{hours} hours").dropDuplicatesWithinWatermark(["_key"]).drop("_key")


def stream_new_fingerprints(cands: DataFrame, processed: DataFrame) -> DataFrame:
    """Rows whose (team_id, fingerprint) is not in the stored set: a stream-static anti-join."""
    return cands.join(processed.select("team_id", "fingerprint"), ["team_id", "fingerprint"], "left_anti")


def keep_fingerprints(path: str):
    """For foreachBatch: adds a batch's fingerprints to the store at path, each once, and a batch that is repeated not again."""

    def add(batch: DataFrame, number: int) -> None:
        FingerprintStore(batch.sparkSession, path).add(batch, number)

    return add


def stream_trends(rows: DataFrame, width: str = "1 hour", slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Counters of total, created and duplicates in time windows, sliding if `slide` is given."""
    decision = F.lower(F.coalesce("decision", F.lit("")))
    counted = rows.withWatermark("ts", late).groupBy(F.window("ts", width, slide) if slide else F.window("ts", width))
    out = counted.agg(F.count("*").alias("total"), F.count_if(decision == "created").alias("created"), F.count_if(decision.startswith("duplicate")).alias("duplicates"))
    return out.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "total", "created", "duplicates")


def error_bursts(rows: DataFrame, gap: str = "120 minutes", by: tuple[str, ...] = ("fingerprint",), late: str | None = "1 hour") -> DataFrame:
    """Sessions of one signature that end after `gap` without it: (by, start, end, n). For streams and tables."""
    timed = rows.withWatermark("ts", late) if rows.isStreaming and late else rows
    grouped = timed.groupBy(*by, F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))
    return grouped.select(*by, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


class Cooldown(StatefulProcessor):
    """Allows a key's first time, and each later one that is at least `gap` microseconds after the last allowed one.

    The state of a key is its last allowed time; a timer ends it once the watermark has passed the gap.
    """

    def __init__(self, gap: int, key_columns: tuple[str, ...]):
        self.gap, self.key_columns = gap, key_columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "last long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        # Frames are taken one by one: of each only its times are kept, 8 bytes a row, as a batch has no order.
        times = np.sort(np.concatenate([frame["at"].to_numpy(np.int64) for frame in rows]))
        old = before = self.last.get()[0] if self.last.exists() else None
        allowed = np.zeros(len(times), bool)
        k = 0
        while k < len(times):  # from one allowed time to the next
            if before is not None:
                k = int(np.searchsorted(times, before + self.gap))
            if k < len(times):
                allowed[k], before = True, int(times[k])
        if before != old:
            if old is not None:
                self.handle.deleteTimer((old + self.gap) // 1000)
            self.last.update((before,))
            self.handle.registerTimer((before + self.gap) // 1000)
        for lo in range(0, len(times), 100_000):
            yield pd.DataFrame({**{c: [v] * len(times[lo : lo + 100_000]) for c, v in zip(self.key_columns, key, strict=True)}, "at": times[lo : lo + 100_000], "allowed": allowed[lo : lo + 100_000]})

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.last.exists() and (self.last.get()[0] + self.gap) // 1000 <= expiredTimerInfo.getExpiryTimeInMs():
            self.last.clear()
        return iter(())

    def close(self) -> None:
        pass


def stream_comment_cooldown(hits: DataFrame, minutes: int, late: str = "1 hour") -> DataFrame:
    """(team_id, ticket_key, ts, allowed) for a stream of hits.

    The state of a ticket is the time of its last allowed comment, kept until the watermark (the latest ts seen less `late`)
    is `minutes` beyond it. Hits before the watermark come too late and are dropped, as are those without a time. In any
    micro-batches of hits that come in time the result is that of comment_cooldown. Start the query inside state_in_rocksdb.
    """
    if minutes <= 0:
        return hits.select("team_id", "ticket_key", "ts", F.lit(True).alias("allowed"))
    timed = hits.where("ts is not null").select("team_id", "ticket_key", "ts", F.unix_micros("ts").alias("at")).withWatermark("ts", late)
    by = ("team_id", "ticket_key")
    told = timed.groupBy(*by).transformWithStateInPandas(Cooldown(minutes * 60_000_000, by), "team_id string, ticket_key string, at long, allowed boolean", "Append", "EventTime")
    return told.select(*by, F.timestamp_micros("at").alias("ts"), "allowed")
