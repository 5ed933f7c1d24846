"""Keyed state with timers: streams that are cut, stopped and started again give the rows of a batch, once."""

import random
from datetime import UTC, datetime

import pytest

from lodestream.plans import streams
from lodestream.streaming import timers


def rows(seed, events, n=120):
    rnd, ts, out = random.Random(seed), 0, []
    for i in range(n):
        ts += rnd.choice([0, 1, 2, 30, 100, 400])
        out.append((f"k{rnd.randrange(4)}", datetime.fromtimestamp(ts + 0.5, UTC).replace(tzinfo=None), ts, i, rnd.choice(events)))
    return out


def table(spark, own):
    return spark.createDataFrame(own, streams.SCHEMA)


def streamed(spark, own, through, path, cuts):
    for a, b in zip([0, *cuts], [*cuts, len(own)], strict=True):
        if a < b:
            table(spark, own[a:b]).coalesce(1).write.mode("append").parquet(f"{path}/in")
        timers.run(spark, f"{path}/in", streams.SCHEMA, through, str(path))
    return sorted(tuple(r) for r in spark.read.schema(timers.OUT).parquet(f"{path}/rows").na.fill(-1).collect())


@pytest.mark.parametrize(("handler", "events"), [(timers.Refresh(), ["look:a", "look:a", "look:b", "done:ok", "done:error"]), (timers.Expire(20), ["press", "tick", "tick"])])
def test_stream_is_the_batch(spark, tmp_path, handler, events):
    own = rows(5, events)
    want = sorted(tuple(r) for r in timers.fold(table(spark, own), handler, own[-1][2]).na.fill(-1).collect())
    assert any(r[2] == -1 for r in want)
    # Cut at places where the time moves on, as a stream in the order of time is; then an empty run.
    cuts = [next(j for j in range(i, len(own)) if own[j][2] > own[j - 1][2]) for i in (30, 70)]
    assert streamed(spark, own, lambda e: timers.timed(e, handler), tmp_path / "cut", [*cuts, len(own)]) == want
    assert streamed(spark, own, lambda e: timers.timed(e, handler), tmp_path / "whole", []) == want


def test_refresh_by_hand():
    h = timers.Refresh()
    out, state, due = timers.steps(h, h.start(), None, "k", iter([(0, 1, "look:a"), (5, 2, "look:a"), (6, 3, "done:error"), (7, 4, "look:a"), (66, 5, "look:a"), (70, 6, "done:ok"), (71, 7, "look:b"), (72, 8, "done:ok"), (80, 9, "done:ok")]))
    assert [(r[1], r[3]) for r in out] == [(0, "reset"), (5, "busy"), (6, "error"), (7, "wait"), (66, "refetch"), (66, "busy"), (70, "ok"), (71, "reset"), (72, "ok"), (80, "ignored")]
    assert state == ("b", False) and due == 372


def test_turns_end_by_themselves(spark, tmp_path):
    at = lambda s: datetime.fromtimestamp(s + 0.5, UTC).replace(tzinfo=None)
    own = [("u", at(ts), ts, i, e) for i, (ts, e) in enumerate([(0, "block:x"), (1, "start"), (2, "tool"), (3, "tool"), (4, "block:y"), (5, "block:x"), (30, "tool"), (31, "start"), (32, "question:q"), (33, "question:q"), (34, "end"), (35, "block:y"), (90, "start")])]
    found = streamed(spark, [*own, ("w", at(200), 200, 99, "end")], lambda e: timers.turns(e, 20), tmp_path / "t", [4, 9])
    assert [r[1:] for r in found if r[0] == "u"] == [
        (0, 0, "group:0"), (1, 1, "start"), (2, 2, "tools:2"), (3, 3, "tools:2+3"), (4, 4, "group:1"), (5, 5, "group:0"), (25, -1, "idle"), (30, 6, "tools:6"), (31, 7, "start"), (32, 8, "new"), (33, 9, "seen"),
        (34, 10, "end"), (35, 11, "group:1"), (90, 12, "start"), (110, -1, "idle"),
    ]


def test_turns_ask_the_store_once_a_call():
    import pandas as pd

    calls = []

    class Store:
        def __getattr__(self, name):
            return lambda *a: calls.append(name)

    p = timers._Turns(20)
    p.handle, p.value, p.tools, p.seen = Store(), Store(), Store(), Store()
    p.tools.get = lambda: calls.append("list") or iter([(1,)])
    rows = pd.DataFrame({"ts": range(50), "event_id": range(2, 52), "event": ["tool", "question:a"] * 25})
    out = next(p.handleInputRows(("u",), iter([rows]), None))
    assert out.result[0] == "tools:1+2" and list(out.result[1::2]) == ["new"] + ["seen"] * 24
    assert len(calls) <= 6
