"""The sequential repeat filter on a stream of events.

Two lists are kept by file in the RocksDB state store: the look-back buffer (live) and the history of removed events
(gone), each event as its detectors and times, from which its pairs follow. Both are bounded by the limits of the filter.
Events of a file must arrive in order; within a micro-batch they are sorted by key. A row with end = true flushes its
file, and so does a timer where no event came for `idle` milliseconds.

The state is written as Avro, so a stream that restarts from its checkpoint may carry more columns than before.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from pulsegrid.operators.repeats import RepeatFold, pairs_of

OUT = [T.StructField("file", T.StringType()), T.StructField("event_key", T.StringType())]
HITS = [T.StructField("dus", T.ArrayType(T.StringType())), T.StructField("times", T.ArrayType(T.LongType()))]
LIVE = [T.StructField("event_key", T.StringType()), *HITS, T.StructField("repeated", T.BooleanType())]


class _Event(dict):
    """The pairs of an event with the hits that they come from; hits without detector or time are left out."""

    def __init__(self, dus: Iterable | None, times: Iterable | None):
        none = dus is None or times is None
        hits = [] if none else [(str(d), int(t)) for d, t in zip(dus, times, strict=True) if not (pd.isna(d) or pd.isna(t))]
        self.dus, self.times = [d for d, _ in hits], [t for _, t in hits]
        super().__init__(pairs_of(self.dus, self.times))


class RepeatProcessor(StatefulProcessor):
    """RepeatFold between two list states; `carried` are fields of the input that return with the key of an event."""

    def __init__(self, carried: Sequence[T.StructField] = (), idle: int | None = None, **limits):
        self.carried, self.idle, self.limits = list(carried), idle, limits

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.live = handle.getListState("live", T.StructType([*LIVE, *self.carried]))
        self.gone = handle.getListState("gone", T.StructType(HITS))

    def _fold(self) -> RepeatFold:
        fold = RepeatFold(**self.limits)
        fold.live.extend([(key, *rest), _Event(dus, times), repeated] for key, dus, times, repeated, *rest in self.live.get())
        fold.gone.extend(_Event(dus, times) for dus, times in self.gone.get())
        return fold

    def _store(self, fold: RepeatFold) -> None:
        # An empty list can't be put.
        live = [(key, e.dus, e.times, repeated, *rest) for (key, *rest), e, repeated in fold.live]
        gone = [(e.dus, e.times) for e in fold.gone]
        for state, rows in ((self.live, live), (self.gone, gone)):
            state.put(rows) if rows else state.clear()

    def _rows(self, file: str | None, kept: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame([(file, *k) for k in kept], columns=["file", "event_key", *(f.name for f in self.carried)], dtype=object)

    def _forget(self) -> None:
        self.live.clear()
        self.gone.clear()
        for t in list(self.handle.listTimers()) if self.idle else []:
            self.handle.deleteTimer(t)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        came = pd.concat(list(rows)).sort_values("event_key", na_position="last")
        over = came["end"].eq(True)
        fold, kept = self._fold(), []
        for r in came[~over].to_dict("records"):
            named = (r["event_key"], *(None if pd.api.types.is_scalar(v) and pd.isna(v) else v for v in (r[f.name] for f in self.carried)))
            kept += fold.push(named, _Event(r["dus"], r["times"]))
        if over.any():
            kept += fold.flush()
        self._forget()
        if not over.any():
            self._store(fold)
            if self.idle:
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle)
        yield self._rows(key[0], kept)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        kept = list(self._fold().flush())
        self._forget()
        yield self._rows(key[0], kept)


def use_rocksdb(spark: SparkSession) -> None:
    """The state store and format that the filter needs, for streams that this session starts from now on."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    spark.conf.set("spark.sql.streaming.stateStore.encodingFormat", "avro")


def filter_stream(events: DataFrame, *, carry: Sequence[str] = (), idle: int | None = None, **limits) -> DataFrame:
    """file, event_key and the columns `carry` of events that stay, from a stream of (file, event_key, dus, times, end).

    A null end counts as false, a null key sorts last, null detectors or times make no pairs; events of an unknown file
    are one file. A file that was flushed, by its end or as idle, begins anew with later events. A column that is carried
    since a restart is null for events that were in the buffer before. Sets the session's state store (`use_rocksdb`).
    """
    use_rocksdb(events.sparkSession)
    carried = [T.StructField(events.schema[c].name, events.schema[c].dataType) for c in carry]
    out = T.StructType([*OUT, *carried])
    rows = events.select("file", "event_key", "dus", "times", "end", *carry)
    return rows.groupBy("file").transformWithStateInPandas(RepeatProcessor(carried, idle, **limits), out, "append", "ProcessingTime" if idle else "None")
