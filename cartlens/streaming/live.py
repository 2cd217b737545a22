"""Streaming twins of batch jobs: the checkout fact that absorbs late events, sessions that close as event time passes, and hourly partner counts."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StringType, StructType, TimestampType

from ..functions.expr import epoch_micros
from ..operators.facts import build_checkout_fact
from ..sources.versions import FAN, Versions, with_entry


def fact_log_writer(spark: SparkSession, path: str, flag_spec: Mapping[str, Column], key: str, first: Mapping[str, Column],
                    sums: Mapping[str, Column] | None = None, stream: str = "events", fan: int = FAN):
    """``foreachBatch`` function that reduces a micro-batch to one row per key and adds it to a log in the folder ``path``.

    The log is a list of folders by levels: ``fan`` batches are reduced to one folder, ``fan`` of these to one of the next level. A version of the manifest names the
    folders and the last batch of each ``stream``: a batch that is run again after a failure is already counted, so that ``sums`` (numbers of events) are right as well as
    flags and first dates. A late event is just a newer row of its key. A stream with a new checkpoint counts its batches anew and needs a name of its own.
    """
    maxes, mins, adds = list(flag_spec), list(first), list(sums or {})
    log = Versions(spark, path)

    def merge(folders: list[str], whole: bool) -> str:
        rows = spark.read.parquet(*[f"{log.root}/{f}" for f in folders])
        return log.write(_reduced(rows, key, maxes, mins, adds))

    def write(batch: DataFrame, batch_id: int) -> None:
        state = {"streams": {}, "entries": [], **log.manifest()}
        if batch_id <= state["streams"].get(stream, -1):
            return
        folder = log.write(build_checkout_fact(batch, flag_spec, key, {**first, **(sums or {})}))
        log.publish({"entries": with_entry(state["entries"], folder, merge, fan), "streams": {**state["streams"], stream: batch_id}, "key": key,
                     "maxes": maxes, "mins": mins, "sums": adds}, state["version"])

    return write


def _reduced(rows: DataFrame, key: str, maxes: Sequence[str], mins: Sequence[str], sums: Sequence[str]) -> DataFrame:
    return rows.groupBy(key).agg(*[F.max(c).alias(c) for c in maxes], *[F.min(c).alias(c) for c in mins], *[F.sum(c).alias(c) for c in sums])


def read_fact_log(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The fact as of a version of the log (the last one, if not given). Equals the fact built from all events at once, since flags only rise, first dates only fall and
    every batch is counted once. A key is read from one folder for each batch of the last few and each level, however many batches there were."""
    log = Versions(spark, path)
    state = log.manifest(version)
    if not state.get("entries"):
        raise ValueError(f"{path} holds no batch yet")
    rows = spark.read.parquet(*[f"{log.root}/{f}" for _, f in state["entries"]])
    return _reduced(rows, state["key"], state["maxes"], state["mins"], state["sums"])


ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Sessions(StatefulProcessor):
    """The open sessions of a key as spans of time, and how many have been closed.

    Times are microseconds. A span is final when the watermark has passed its last event by the gap: no event that is still to come can lie near it.
    """

    def __init__(self, gap_seconds: int, keys: Sequence[str], day: str, device: str):
        self.gap, self.keys, self.day, self.device = gap_seconds * 1_000_000, list(keys), keys.index(day), keys.index(device)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.spans = handle.getListState("spans", "first long, last long, events long")
        self.closed = handle.getValueState("closed", "n long")

    def joined(self, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        """Spans in order, put together where less than the gap lies between them."""
        out: list[tuple[int, int, int]] = []
        for first, last, n in sorted(spans):
            if out and first - out[-1][1] < self.gap:
                a, b, m = out[-1]
                out[-1] = (a, max(b, last), m + n)
            else:
                out.append((first, last, n))
        return out

    def wait(self, spans: list[tuple[int, int, int]]) -> None:
        """One timer for each key: when its earliest open session is over."""
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if spans:
            self.handle.registerTimer(-(-(spans[0][1] + self.gap) // 1000))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        spans = [tuple(int(x) for x in s) for s in self.spans.get()] if self.spans.exists() else []
        for batch in rows:
            t = np.sort(batch["event_us"].to_numpy(np.int64))
            cut = np.flatnonzero(np.diff(t) >= self.gap) + 1
            starts, ends = np.r_[0, cut], np.r_[cut, len(t)]
            spans = self.joined([*spans, *((int(t[a]), int(t[b - 1]), int(b - a)) for a, b in zip(starts, ends))])
        self.spans.put(spans)
        self.wait(spans)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        spans = sorted(tuple(int(x) for x in s) for s in self.spans.get()) if self.spans.exists() else []
        done = [s for s in spans if s[1] + self.gap <= passed]
        before = int(self.closed.get()[0]) if self.closed.exists() else 0
        rows = [(*key, before + i, f"{before + i}-{key[self.day]}-{key[self.device]}", pd.Timestamp(a, unit="us"), pd.Timestamp(b, unit="us"), n)
                for i, (a, b, n) in enumerate(done, 1)]
        self.closed.update((before + len(done),))
        rest = spans[len(done):]
        self.spans.put(rest) if rest else self.spans.clear()
        self.wait(rest)
        if rows:
            yield pd.DataFrame(rows, columns=[*self.keys, "session_no", "session_id", "started", "ended", "events"])


def stream_sessions(events: DataFrame, keys: Sequence[str], ts: str, lateness: str = "1 hour", gap_seconds: int = 1800, day: str = "dt",
                    device: str = "device_id") -> DataFrame:
    """Sessions of a stream of events, each sent out once, when it is over: keys, ``session_no``, ``session_id``, ``started``, ``ended``, ``events``.

    Numbers and ids are those of ``sessionize``, however the events are cut into micro-batches and ordered within the ``lateness``: late events extend a session, open one
    between two others, or join two, as long as these are open. The state of a key is one span for each open session, whatever number of events
    it has. Events without a time or a key have no session. A session keeps no events; ``session_of`` looks its events up.
    """
    spark = events.sparkSession
    if spark.conf.get("spark.sql.streaming.stateStore.providerClass", "") != ROCKS:
        raise ValueError(f"set spark.sql.streaming.stateStore.providerClass to {ROCKS}")
    known = F.col(ts).isNotNull()
    for k in keys:
        known = known & F.col(k).isNotNull()
    timed = events.filter(known).select(*keys, F.col(ts).cast("timestamp").alias("event_at")).withWatermark("event_at", lateness).withColumn("event_us", epoch_micros("event_at"))
    out = StructType([timed.schema[k] for k in keys]).add("session_no", LongType()).add("session_id", StringType()).add(
        "started", TimestampType()).add("ended", TimestampType()).add("events", LongType())
    return timed.groupBy(*keys).transformWithStateInPandas(
        Sessions(gap_seconds, list(keys), day, device), out, "Append", "EventTime")


def session_of(events: DataFrame, sessions: DataFrame, keys: Sequence[str], ts: str, chunk_seconds: int = 600) -> DataFrame:
    """Events with ``session_no`` and ``session_id`` of closed sessions: the last one of the key that had started; NULL for events of open ones."""
    from ..functions.scan import last_before

    take = {"session_no": "session_no", "session_id": "session_id", "__ended": "ended"}
    found = last_before(events.withColumn("__at", F.col(ts).cast("timestamp")), sessions, keys, "__at", "started", take, chunk_seconds, allow_equal=True)
    inside = F.col("__at") <= F.col("__ended")
    return found.select(*events.columns, *[F.when(inside, F.col(c)).alias(c) for c in ("session_no", "session_id")])


def hourly_ids(events: DataFrame, ts: str, entity: str, step: Column, ident: str, lateness: str = "1 hour") -> DataFrame:
    """Distinct ids per entity, step and hour as event time passes.

    Repeats of an id within its hour are dropped with state bounded by the watermark;
    an hour is sent out once when it can no longer change.
    """
    d = events.select(F.col(ts).cast("timestamp").alias("__t"), entity, step.alias("step"), ident).filter(F.col("step").isNotNull())
    d = d.withWatermark("__t", lateness).withColumn("hour", F.window("__t", "1 hour"))
    once = d.dropDuplicates(["hour", entity, "step", ident])
    return once.groupBy("hour", entity, "step").agg(F.count("*").alias("ids")).select(
        F.col("hour.start").alias("hour"), entity, "step", "ids")
