"""Streaming forms of the log operators; each has a batch twin."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from veilspark.functions.scoring import noisy_or
from veilspark.functions.text import shape_hits
from veilspark.sources.sinks import shared_folder


def parquet_stream(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A table as a stream, be it one file or a folder of files. A stream takes a single file only by a pattern, which the brackets make of its name."""
    schema = spark.read.parquet(f"{path}/{name}").schema
    return spark.readStream.schema(schema).parquet(f"{path}/{name[:-1]}[{name[-1]}]")


def latest_per_key(stream: DataFrame, key: str, value: str, *order: str) -> DataFrame:
    """Latest wins, as state of one struct a key (update or complete mode)."""
    return stream.groupBy(key).agg(F.max_by(value, F.struct(*order)).alias(value), F.count(F.lit(1)).alias("n_records"))


def counts_by_window(stream: DataFrame, ts: str, key: str, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Event counts by window. The watermark is an addition of this library."""
    return stream.withWatermark(ts, late).groupBy(F.window(ts, width), key).agg(F.count(F.lit(1)).alias("n"))


def screened(messages: DataFrame, text: str = "text") -> DataFrame:
    """Stateless screening of outbound messages: shapes found, score, whether to block."""
    hits = F.coalesce(shape_hits(F.col(text)), F.array())
    rows = messages.withColumn("hits", hits)
    score = noisy_or(F.transform("hits", lambda h: h["weight"]))
    return rows.withColumn("score", score).withColumn("blocked", score >= 0.3)


def json_stream(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Audit and decision logs as they are appended, one JSON object a line."""
    return spark.readStream.schema(schema).json(path)


def streamed_episodes(stream: DataFrame, key: str, ts: str, opener: Column, late: str = "1 hour", tie: str | None = None, slot_ms: int = 3_600_000, keep_ms: int | None = None) -> DataFrame:
    """key, ts, tie (where one is named) and episode of each event: a new episode at each opener, what comes before the first
    belongs to it. The twin of `stores.episodes` over ts and tie (a whole number; where none is named, of equal times openers come last).

    Events are numbered once the watermark is past the end of their slot of event time (slots keep the state from being written
    anew at every step of the watermark); those that come later are left out, as are events without a time. A null opener opens
    nothing; a null key is a key. With keep_ms a key is forgotten that long after its last event, and its episodes begin again at
    1; without, its count stays for ever.

    The state of a key is its count and the list of events that wait, packed: a batch appends its events as one value, a timer at
    the end of the first waiting slot reads all and puts back what waits on. (Each value costs Python and the JVM a message and a
    pickle, which outweigh the event.) A null tie comes first. Memory: the waiting events of one key, which last late, a slot and a
    batch at most. Needs the RocksDB state store (`drained` with rocksdb).
    """
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    place = F.col(tie).cast("long") if tie else F.lit(0).cast("long")
    flags = F.coalesce(opener, F.lit(False)).cast("int") + TIED * place.isNotNull().cast("int")
    rows = stream.select(
        F.col(key).alias("key"), F.col(ts).cast("timestamp").alias("ts"), at.alias("at"), F.coalesce(place, F.lit(0).cast("long")).alias("tie"), flags.alias("flags")
    ).filter("ts is not null").withWatermark("ts", late)
    kind = stream.schema[key].dataType.simpleString()
    numbered = rows.groupBy("key").transformWithStateInPandas(Episodes(slot_ms, keep_ms), f"key {kind}, at long, tie long, flags int, episode long", "append", "EventTime")
    named = [F.col("key").alias(key), F.timestamp_micros("at").alias(ts), *([F.when(F.col("flags") >= TIED, F.col("tie")).alias(tie)] if tie else []), "episode"]
    return numbered.select(*named)


#: An event as it waits; its flags: 1 if it opens, TIED if its tie is not null.
EVENT, TIED = np.dtype([("at", "<i8"), ("tie", "<i8"), ("flags", "<i4")]), 2


class Episodes(StatefulProcessor):
    """Numbers the events of a key as the watermark passes; see `streamed_episodes`."""

    def __init__(self, slot_ms: int, keep_ms: int | None) -> None:
        self.slot, self.keep = slot_ms * 1000, keep_ms and keep_ms * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "openers long, last long")
        self.waiting = handle.getListState("waiting", "events binary")

    def timer(self, at: int) -> None:
        """At the end of the slot of at."""
        self.handle.registerTimer((at // self.slot + 1) * self.slot // 1000)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        first = None
        for frame in rows:
            events = np.empty(len(frame), EVENT)
            for c in EVENT.names:
                events[c] = frame[c].to_numpy()
            self.waiting.appendValue((events.tobytes(),))
            first = min(int(events["at"].min()), first if first is not None else int(events["at"].min()))
        if first is not None:
            self.timer(first)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        events = np.frombuffer(b"".join(bytes(packed) for packed, in self.waiting.get()), EVENT)
        opens, tied = events["flags"] % TIED, events["flags"] >= TIED
        events = events[np.lexsort((opens, events["tie"], tied, events["at"]))]
        ready = int(np.searchsorted(events["at"], passed // self.slot * self.slot))
        done, left = events[:ready], events[ready:]
        openers, last = self.seen.get() or (0, None)
        if len(done):
            opens = (done["flags"] % TIED).astype("int64")
            counts = openers + opens.cumsum()
            if self.keep:  # after a silence what was counted before it falls out
                silent = np.diff(done["at"], prepend=done["at"][0] if last is None else last) >= self.keep
                counts -= np.maximum.accumulate(np.where(silent, counts - opens, 0))
            openers, last = int(counts[-1]), int(done["at"][-1])
            self.seen.update((openers, last))
            if len(left):
                self.waiting.put([(left.tobytes(),)])
            else:
                self.waiting.clear()
            if self.keep:
                self.timer(last + self.keep)
            yield pd.DataFrame({"key": [key[0]] * len(done)} | {c: done[c] for c in EVENT.names} | {"episode": np.maximum(counts, 1)})
        if len(left):
            self.timer(int(left["at"][0]))
        elif self.keep and last is not None and last + self.keep <= passed:
            self.seen.clear()

    def close(self) -> None:
        pass


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def drained(spark: SparkSession, stream: DataFrame, name: str, mode: str = "append", rocksdb: bool = False) -> DataFrame:
    """Runs a stream over all there is, into a table in the shared folder with its checkpoint beside it.

    rocksdb: with that state store, for this stream alone (a stream takes the session's settings as it starts and keeps its store).
    """
    top = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    writer = stream.writeStream.option("checkpointLocation", f"{top}/state").trigger(availableNow=True)
    if mode == "append":
        writer = writer.format("parquet").option("path", f"{top}/rows").outputMode("append")
    else:  # all results of one batch; a later batch replaces them
        writer = writer.foreachBatch(lambda rows, _: rows.write.mode("overwrite").parquet(f"{top}/rows")).outputMode(mode)
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider)
    if rocksdb:
        spark.conf.set(provider, ROCKSDB)
    try:
        running = writer.start()
    finally:
        spark.conf.set(provider, before)
    running.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{top}/rows")
