"""Keyed state over event streams: latest values, cached keys, rings, schedules, expiring results, turns.

Timers of the interactive original run on processing time; here they are set on the events' own
clock (a column), so that a stream and a batch give the same rows. Handlers are pure functions of
state and event; `run_stream` feeds a file stream through them with applyInPandasWithState, and
`fold` applies the same handler to a batch, one key after the other.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

# Fixed values, in seconds: refresh after success and failure, and how long a result shows.
REFRESH, RETRY, SHOWN = 300, 60, 3

Handler = Callable[[tuple | None, int, str], tuple[tuple, str]]


def refresh(state: tuple | None, ts: int, event: str) -> tuple[tuple, str]:
    """State (target, next due). A new target clears and fetches at once; else only when due."""
    target, due = state or ("", 0)
    name, _, result = event.partition(":")
    if name == target and ts < due:
        return (target, due), "wait"
    return (name, ts + (RETRY if result == "error" else REFRESH)), "reset" if name != target else "fetch"


def expire(state: tuple | None, ts: int, event: str) -> tuple[tuple, str]:
    """State (until). A press shows its result for a while; a new press starts the time again."""
    (until,) = state or (0,)
    if event == "press":
        return (ts + SHOWN,), "shown"
    return (until,), "shown" if ts < until else "idle"


def reload(state: tuple | None, ts: int, event: str) -> tuple[tuple, str]:
    """State (name). idle -> loading -> done or failed -> idle; a start while loading changes nothing."""
    (name,) = state or ("idle",)
    to = {("idle", "start"): "loading", ("loading", "ok"): "done", ("loading", "error"): "failed", ("done", "tick"): "idle", ("failed", "tick"): "idle"}
    name = to.get((name, event), name)
    return (name,), name


def fold(rows: DataFrame, handler: Handler) -> DataFrame:
    """A batch of key, ts, event through a handler: keys come sorted, one state is held at a time, and no key's events are gathered."""

    def run(batches):
        held, state = object(), None
        for batch in batches:
            out = []
            for key, ts, event in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if key != held:
                    held, state = key, None
                state, result = handler(state, ts, event)
                out.append(result)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string())], ["key", "ts", "event", "result"])

    own = rows.select("key", "ts", "event").repartition("key").sortWithinPartitions("key", "ts", "event")
    return own.mapInArrow(run, "key string, ts long, event string, result string")


def run_stream(events: DataFrame, handler: Handler, state_schema: str) -> DataFrame:
    """A stream of key, ts, event through a handler; state stays in the store between batches."""

    def step(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(frames)).sort_values(["ts", "event"])
        now, out = state.get if state.exists else None, []
        for ts, event in zip(pdf.ts, pdf.event, strict=True):
            now, result = handler(now, int(ts), event)
            out.append(result)
        state.update(now)
        yield pdf.assign(result=out)[["key", "ts", "event", "result"]]

    return events.groupBy("key").applyInPandasWithState(step, "key string, ts long, event string, result string", state_schema, "append", GroupStateTimeout.NoTimeout)
