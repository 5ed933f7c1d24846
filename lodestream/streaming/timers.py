"""Keyed state with timers: transformWithStateInPandas, event time, and the same handlers over a batch.

A handler is a pure function of state and event, and of state and timer. A key has one timer at most;
where the next event of the key is due later than the timer, the timer goes first, whether both come
in one batch or the engine fires it when the watermark has passed it, so that the rows do not depend
on how a stream is cut into batches. A timer fires without any event, and a stream that is started
again from its checkpoint goes on where it stood.

Events are sorted by time within a key and a batch, so what a task holds is a key's events of one
batch, which the source's limits bound. Events must come in the order of time up to the watermark.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .state import REFRESH, RETRY, SHOWN

OUT = "key string, ts long, event_id long, result string"
_NAMES = ["key", "ts", "event_id", "result"]


class Refresh:
    """When a target is fetched: at once if it is new, again some time after a success or a failure, never while a fetch is under way.

    Events: look:<target>, done:ok, done:error. The timer starts the next fetch by itself.
    """

    schema = "target string, busy boolean"

    def __init__(self, unit: int = 1):
        self.after = {"ok": REFRESH * unit, "error": RETRY * unit}

    def start(self) -> tuple:
        return ("", False)

    def event(self, state: tuple, due: int | None, ts: int, event_id: int, event: str) -> tuple[tuple, int | None, str]:
        target, busy = state
        what, _, name = event.partition(":")
        if what == "done":
            return ((target, False), ts + self.after[name], name) if busy else (state, due, "ignored")
        if name != target:
            # Another target clears what was known; an answer for the old one counts for nothing.
            return (name, True), None, "reset"
        if busy:
            return state, due, "busy"
        return (state, due, "wait") if due is not None else ((target, True), None, "fetch")

    def timer(self, state: tuple, ts: int) -> tuple[tuple, int | None, str]:
        return (state[0], True), None, "refetch"


class Expire:
    """A result that shows for a while after each press; the time begins anew with another press. Events: press, tick."""

    schema = "shown boolean"

    def __init__(self, unit: int = 1):
        self.shown = SHOWN * unit

    def start(self) -> tuple:
        return (False,)

    def event(self, state, due, ts, event_id, event):
        if event == "press":
            return (True,), ts + self.shown, "again" if state[0] else "shown"
        return state, due, "on" if state[0] else "off"

    def timer(self, state, ts):
        return (False,), None, "expired"


def steps(handler, state: tuple, due: int | None, key: str, events: Iterator[tuple[int, int, str]]):
    """Rows of a key's events in order, with the timers that are due before them; ends with state and due."""
    rows = []
    for ts, event_id, event in events:
        while due is not None and due <= ts:
            at = due
            state, due, result = handler.timer(state, at)
            rows.append((key, at, None, result))
        state, due, result = handler.event(state, due, ts, event_id, event)
        rows.append((key, ts, event_id, result))
    return rows, state, due


def _frame(rows: list[tuple]) -> pd.DataFrame:
    key, ts, event_id, result = zip(*rows, strict=True) if rows else ((), (), (), ())
    none = np.array([i is None for i in event_id], bool)
    ids = pd.arrays.IntegerArray(np.array([i or 0 for i in event_id], np.int64), none)
    return pd.DataFrame(dict(zip(_NAMES, (np.array(key, object), np.array(ts, np.int64), ids, np.array(result, object)), strict=True)))


def _sorted(frames: Iterator[pd.DataFrame]) -> list[tuple[int, int, str]]:
    """A key's events in order; plain lists, as most keys have few."""
    return sorted((e for f in frames for e in zip(f["ts"].tolist(), f["event_id"].tolist(), f["event"].tolist(), strict=True)), key=lambda e: e[:2])


class _Timed(StatefulProcessor):
    """A handler whose state and timer are one value of the store."""

    def __init__(self, handler):
        self.handler = handler

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.value = handle.getValueState("state", self.handler.schema + ", due long")

    def _held(self) -> tuple[tuple, int | None]:
        held = tuple(self.value.get() or (*self.handler.start(), None))
        return held[:-1], held[-1]

    def _keep(self, state: tuple, before: int | None, due: int | None) -> None:
        self.value.update((*state, due))
        if before != due:
            if before is not None:
                self.handle.deleteTimer(before * 1000)
            if due is not None:
                self.handle.registerTimer(due * 1000)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        state, before = self._held()
        out, state, due = steps(self.handler, state, before, key[0], _sorted(rows))
        self._keep(state, before, due)
        yield _frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        at = expiredTimerInfo.getExpiryTimeInMs() // 1000
        state, before = self._held()
        if before != at:  # set anew in the meantime
            return
        state, due, result = self.handler.timer(state, at)
        self.value.update((*state, due))
        if due is not None:
            self.handle.registerTimer(due * 1000)
        yield _frame([(key[0], at, None, result)])

    def close(self) -> None:
        pass


class _Turns(StatefulProcessor):
    """Turns of a key: a value (turn, whether it runs, whether any has ended, timer), a list of the turn's tools, a map of blocks to groups and of questions seen.

    Events: start, tool, block:<id>, question:<id>, end. A block's group is the one it had, else the
    running turn, else itself. A running turn without events for `idle` seconds ends by its timer.
    """

    def __init__(self, idle: int):
        self.idle = idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.value = handle.getValueState("turn", "turn long, running boolean, ended boolean, due long")
        self.tools = handle.getListState("tools", "id long")
        self.seen = handle.getMapState("seen", "id string", "group_id long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        turn, running, ended, before = self.value.get() or (None, False, False, None)
        out, due = [], before
        # What the store holds is asked for once a call, and written once: each question is a round trip.
        tools: list | None = None
        seen: dict[str, int | None] = {}
        fresh = set()
        emptied = changed = False
        for ts, event_id, event in _sorted(rows):
            if due is not None and due <= ts:
                out.append((key[0], due, None, "idle"))
                tools, emptied = [], True
                turn, running, ended, due = None, False, True, None
            what = event.partition(":")[0]
            if what in ("start", "end"):
                result = "start" if what == "start" else "end" if running else "no turn"
                turn, running, ended = (event_id, True, ended) if what == "start" else (None, False, True)
                tools, emptied = [], True
            elif what == "tool":
                if tools is None:
                    tools = [t[0] for t in self.tools.get()]
                tools.append(event_id)
                changed = True
                result = "tools:" + "+".join(map(str, tools))
            else:
                if event not in seen:
                    seen[event] = (self.seen.getValue((event,)) or (None,))[0]
                known = seen[event] is not None
                if not known:
                    seen[event] = turn if running else event_id
                    fresh.add(event)
                result = f"group:{seen[event]}" if what != "question" else "seen" if known else "new"
            due = ts + self.idle if running else None
            out.append((key[0], ts, event_id, result))
        if tools and changed:
            self.tools.put([(t,) for t in tools])
        elif emptied:
            self.tools.clear()
        for event in fresh:
            self.seen.updateValue((event,), (seen[event],))
        if before != due:
            if before is not None:
                self.handle.deleteTimer(before * 1000)
            if due is not None:
                self.handle.registerTimer(due * 1000)
        self.value.update((turn, running, ended, due))
        yield _frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        at = expiredTimerInfo.getExpiryTimeInMs() // 1000
        held = self.value.get()
        if not held or held[3] != at:
            return
        self.tools.clear()
        self.value.update((None, False, True, None))
        yield _frame([(key[0], at, None, "idle")])

    def close(self) -> None:
        pass


def timed(events: DataFrame, handler) -> DataFrame:
    """A stream of key, time, ts, event_id and event through a handler with timers."""
    return _transformed(events, _Timed(handler))


def turns(events: DataFrame, idle: int) -> DataFrame:
    return _transformed(events, _Turns(idle))


def _transformed(events: DataFrame, processor: StatefulProcessor) -> DataFrame:
    own = events.withWatermark("time", "0 seconds").groupBy("key")
    return own.transformWithStateInPandas(processor, OUT, "append", "eventTime")


_STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


@contextmanager
def _state_store(spark: SparkSession):
    """The store that holds keyed state with timers; the session's own setting comes back afterwards."""
    before = {k: spark.conf.get(k, None) for k in _STORE}
    for k, v in _STORE.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def run(spark: SparkSession, source: str, schema: str, through: Callable[[DataFrame], DataFrame], to: str, files: int | None = None) -> None:
    """All that is new in a folder of Parquet through a stream to another folder; started again, it goes on from its checkpoint, and every row is written once."""
    reader = spark.readStream.schema(schema)
    events = (reader.option("maxFilesPerTrigger", files) if files else reader).parquet(source)
    with _state_store(spark):
        q = through(events).writeStream.format("parquet").option("path", to + "/rows").option("checkpointLocation", to + "/checkpoint").trigger(availableNow=True).start()
        q.awaitTermination()


def fold(events: DataFrame, handler, end: int) -> DataFrame:
    """The same rows of a batch of key, ts, event_id and event: keys one after the other, then the timers due until `end`."""

    def run(batches):
        held, state, due = None, None, None

        def closing():
            nonlocal state, due
            rows = []
            while held is not None and due is not None and due <= end:
                at = due
                state, due, result = handler.timer(state, at)
                rows.append((held, at, None, result))
            return rows

        def batch_of(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)], _NAMES)

        for batch in batches:
            out = []
            for key, ts, event_id, event in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if key != held:
                    out += closing()
                    held, state, due = key, handler.start(), None
                rows, state, due = steps(handler, state, due, key, iter([(ts, event_id, event)]))
                out += rows
            if out:
                yield batch_of(out)
        last = closing()
        if last:
            yield batch_of(last)

    own = events.select("key", "ts", "event_id", "event").repartition("key").sortWithinPartitions("key", "ts", "event_id")
    return own.mapInArrow(run, OUT)


def epoch(c) -> Column:
    return F.floor(F.unix_micros(c.cast("timestamp")) / 1_000_000)
