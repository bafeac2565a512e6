"""Streams: resumable work lists over appended rows, sentinels, and a state machine per key that may be replayed."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQueryListener
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues

from ..sources.files import append_batch, update_state

#: States of a submission, and an error that asks for another try in the next cycle.
NEW, RETRY, DONE, FAILED = "new", "retry", "submitted", "failed"
#: Status of the rows by which a timer asks for the next try, and the provider that timers need.
DUE, ROCKSDB = "due", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUTPUT = "slug string, status string, attempts int, event_time timestamp, err string"
_STATE = "status string, attempts int, event_time timestamp, err string"


def trace_stream(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Rows appended to JSON lines below a folder."""
    return spark.readStream.schema(schema).option("mode", "DROPMALFORMED").json(path)


def sentinels(spark: SparkSession, root: str, name: str = "*.done") -> DataFrame:
    """Runs whose sentinel file, written last, has appeared: path and run."""
    found = spark.readStream.format("text").option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", name).load(root)
    path = F.col("_metadata.file_path")
    return found.select(path.alias("path"), F.element_at(F.split(path, "/"), -2).alias("run"))


def distinct_keys(stream: DataFrame, keys: list[str], time: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Each key once, also when its rows are replayed; with a time column state is kept for the late interval only."""
    return stream.dropDuplicates(keys) if time is None else stream.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def next_state(state: tuple[str, int, Any, str | None], outcome: str, time: Any, err: str | None, most: int) -> tuple[str, int, Any, str | None]:
    """The transition of a key: done and failed stay; success ends it; an error is tried again, `most` times in all.
    A quota error does not count as a try."""
    status, attempts, since, why = state
    if status in (DONE, FAILED):
        return state
    if outcome == "ok":
        return DONE, attempts + 1, time, None
    if outcome == "quota":
        return RETRY, attempts, time, err
    attempts += 1
    return (FAILED if attempts >= most else RETRY), attempts, time, err


def submissions(events: DataFrame, most: int = 3) -> DataFrame:
    """A stream of states per slug from events (slug, outcome, event_time, err); replays of ended slugs change nothing."""

    def advance(key: tuple, frames: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        state = held.get if held.exists else (NEW, 0, None, None)
        for frame in frames:
            for row in frame.sort_values("event_time", kind="stable").itertuples(index=False):
                state = next_state(tuple(state), row.outcome, row.event_time, row.err, most)
        held.update(tuple(state))
        yield pd.DataFrame([(key[0], *state)], columns=["slug", "status", "attempts", "event_time", "err"])

    return events.select("slug", "outcome", "event_time", "err").groupBy("slug").applyInPandasWithState(advance, OUTPUT, _STATE, "update", GroupStateTimeout.NoTimeout)


class _Attempts(StatefulProcessor):
    """The state machine of a slug with a timer for its next try; ended slugs are forgotten after a while."""

    def __init__(self, most: int, cycle_ms: int, keep_ms: int) -> None:
        self.most, self.cycle_ms, self.keep_ms = most, cycle_ms, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.live, self.ended = handle, handle.getValueState("live", _STATE), handle.getValueState("ended", _STATE, ttlDurationMs=self.keep_ms)

    def _held(self) -> tuple[str, int, Any, str | None]:
        for state in (self.ended, self.live):
            if state.exists():
                return tuple(state.get())
        return NEW, 0, None, None

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        state = before = self._held()
        for row in pd.concat(list(rows)).sort_values("event_time", kind="stable").itertuples(index=False):
            state = next_state(state, row.outcome, row.event_time, row.err, self.most)
        if state != before:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            if state[0] in (DONE, FAILED):
                self.live.clear()
                self.ended.update(state)
            else:
                self.live.update(state)
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.cycle_ms)
        yield pd.DataFrame([(key[0], *state)], columns=["slug", "status", "attempts", "event_time", "err"])

    def handleExpiredTimer(self, key: Any, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.live.exists():
            _, attempts, time, err = self.live.get()
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.cycle_ms)  # until an event comes
            yield pd.DataFrame([(key[0], DUE, attempts, time, err)], columns=["slug", "status", "attempts", "event_time", "err"])

    def close(self) -> None:
        pass


def timed_submissions(events: DataFrame, most: int = 3, cycle_ms: int = 600_000, keep_ms: int = 7 * 86_400_000) -> DataFrame:
    """submissions() that says itself when a try is due: a slug that waits for one gives a row of status `due` every
    cycle, without a new event, until an event comes. Slugs that ended are held for keep_ms, in which replays of their
    events change nothing, and then dropped, so the state holds waiting slugs and recently ended ones only. It needs the
    RocksDB state store (spark.sql.streaming.stateStore.providerClass)."""
    rows = events.select("slug", "outcome", "event_time", "err").groupBy("slug")
    return rows.transformWithStateInPandas(_Attempts(most, cycle_ms, keep_ms), OUTPUT, "update", "processingTime")


def latest(states: DataFrame, key: str, time: str) -> DataFrame:
    """The batch twin of the stream: the last row of each key, reduced before the shuffle."""
    rest = [c for c in states.columns if c != key]
    return states.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(time, *[c for c in rest if c != time])).alias("_last")).select(key, "_last.*")


def upsert(path: str, key: str, time: str) -> Callable[[DataFrame, int], None]:
    """A function for foreachBatch that merges each batch into a keyed state table by its latest rows. Several streams
    may merge into one table at a time."""

    def merge(batch: DataFrame, _: int) -> None:
        update_state(batch.sparkSession, path, lambda old: latest(batch if old is None else old.unionByName(batch), key, time))

    return merge


def append_once(path: str, keys: list[str], query: str) -> Callable[[DataFrame, int], None]:
    """A function for foreachBatch that appends each batch of the query of this name to a log exactly once, also when the
    batch is replayed after a restart, and never a key that the log has without an error."""

    def append(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        try:
            append_batch(batch, path, f"{query}-{number}", keys)
        finally:
            batch.unpersist()

    return append


class Progress(StreamingQueryListener):
    """Counts the rows of all batches of every query; passed() gives the multiples of `step` that one has passed. Register
    it by spark.streams.addListener before the query starts."""

    def __init__(self, step: int = 50) -> None:
        self.step, self.rows = step, {}

    def onQueryStarted(self, event: Any) -> None:
        self.rows.setdefault(str(event.id), 0)

    def onQueryProgress(self, event: Any) -> None:
        of = str(event.progress.id)
        self.rows[of] = self.rows.get(of, 0) + event.progress.numInputRows

    def onQueryIdle(self, event: Any) -> None:
        pass

    def onQueryTerminated(self, event: Any) -> None:
        pass

    def passed(self, query: Any) -> list[int]:
        return list(range(self.step, self.rows.get(str(query.id), 0) + 1, self.step))
