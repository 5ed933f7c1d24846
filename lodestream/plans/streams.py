"""Streams with timers over the events, run in parts and started again from their checkpoint."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import corpus, store
from ..streaming import timers

SCHEMA = "key string, time timestamp, ts long, event_id long, event string"
#: Parts that the events come in, one run of the stream each; seconds that stand for one of the handlers', and for a turn without events.
PARTS, UNIT, IDLE = 3, 3600, 12 * 3600


def _events(spark, sf_dir, event: str) -> DataFrame:
    e = corpus.table(spark, sf_dir, "events")
    return e.select(F.col("user_id").cast("string").alias("key"), F.col("ts").cast("timestamp").alias("time"), timers.epoch(F.col("ts")).alias("ts"), "event_id", F.expr(event).alias("event"))


def _streamed(spark, sf_dir, event: str, through) -> DataFrame:
    """The rows of a stream that is fed part by part, by time, and stopped and started in between."""
    events = _events(spark, sf_dir, event)
    path = store.fresh(spark, "stream")
    cuts = events.select(F.expr(f"approx_percentile(unix_micros(time), array({', '.join(str(i / PARTS) for i in range(1, PARTS))}))").alias("c")).first().c or []
    at = F.unix_micros("time")
    for low, high in zip([None, *cuts], [*cuts, None], strict=True):
        part = events.where((at >= low) if low is not None else F.lit(True)).where((at < high) if high is not None else F.lit(True))
        part.write.mode("append").parquet(path + "/in")
        timers.run(spark, path + "/in", SCHEMA, through, path)
    return spark.read.schema(timers.OUT).parquet(path + "/rows")


_LOOK = "CASE event_type WHEN 'error' THEN 'done:error' WHEN 'purchase' THEN 'done:ok' ELSE IF(event_type = 'signup' AND user_id % 3 = 0, 'look:dev', 'look:main') END"
_PRESS = "IF(event_type = 'purchase', 'press', 'tick')"
_TURN = "CASE event_type WHEN 'signup' THEN 'start' WHEN 'purchase' THEN 'end' WHEN 'click' THEN 'tool' WHEN 'view' THEN concat('block:', floor(value) % 9) ELSE concat('question:', floor(value) % 9) END"


def refresh_stream(spark, sf_dir) -> DataFrame:
    """When each user's target is fetched, with refetches that a timer starts."""
    return _streamed(spark, sf_dir, _LOOK, lambda e: timers.timed(e, timers.Refresh(UNIT // 60)))


def expiry_stream(spark, sf_dir) -> DataFrame:
    """Results shown after a press, which expire by themselves."""
    return _streamed(spark, sf_dir, _PRESS, lambda e: timers.timed(e, timers.Expire(UNIT)))


def turns_stream(spark, sf_dir) -> DataFrame:
    """Turns with the ids of their tools, groups of blocks and questions seen; a turn without events ends by its timer."""
    return _streamed(spark, sf_dir, _TURN, lambda e: timers.turns(e, IDLE))


def _machine(event: str, state: str, fired: str, seen: str) -> str:
    """Recursion over each key's events and timers: s is the state before, x the next event; `fired` and `seen` list result, state and due after a timer or an event."""
    pairs = [f"CASE WHEN go THEN {a} ELSE {b} END" for a, b in zip(fired.split(" ;; "), seen.split(" ;; "), strict=True)]
    names = [p.rsplit(" AS ", 1)[1] for p in state.split(" ;; ")]
    held = ", ".join(f"s.{n} AS {n}" for n in names)
    return f"""WITH RECURSIVE e AS MATERIALIZED (SELECT CAST(user_id AS VARCHAR) AS key, CAST(row_number() OVER (PARTITION BY user_id ORDER BY floor(epoch(ts)), event_id) AS BIGINT) AS n, CAST(floor(epoch(ts)) AS BIGINT) AS ts, event_id, {event} AS event FROM events),
last AS MATERIALIZED (SELECT max(ts) AS fin FROM e),
m AS (SELECT key, 0::BIGINT AS n, NULL::BIGINT AS ts, NULL::BIGINT AS event_id, NULL::VARCHAR AS result, {', '.join(state.split(' ;; '))}, NULL::BIGINT AS due FROM (SELECT DISTINCT key FROM e)
  UNION ALL SELECT key, CASE WHEN go THEN n ELSE n + 1 END, CASE WHEN go THEN due ELSE x_ts END, CASE WHEN go THEN NULL ELSE x_id END, {', '.join(pairs)}
  FROM (SELECT s.key, s.n, {held}, s.due, x.ts AS x_ts, x.event_id AS x_id, x.event AS x, s.due IS NOT NULL AND s.due <= coalesce(x.ts, fin) AS go FROM m s CROSS JOIN last LEFT JOIN e x ON x.key = s.key AND x.n = s.n + 1) WHERE go OR x_ts IS NOT NULL)
SELECT key, ts, event_id, result FROM m WHERE ts IS NOT NULL"""


_NAME = "split_part(x, ':', 2)"
_DONE, _NEW = "starts_with(x, 'done')", f"target <> {_NAME}"
_AFTER = f"CASE WHEN {_NAME} = 'ok' THEN {300 * UNIT // 60} ELSE {60 * UNIT // 60} END"
_KNOWN = "map_contains(seen, x)"
_OWN = "CASE WHEN running THEN turn ELSE x_id END"
QUERIES = {f.__name__: f for f in (refresh_stream, expiry_stream, turns_stream)}
ORACLES = {
    "refresh_stream": _machine(
        "CASE event_type WHEN 'error' THEN 'done:error' WHEN 'purchase' THEN 'done:ok' ELSE CASE WHEN event_type = 'signup' AND user_id % 3 = 0 THEN 'look:dev' ELSE 'look:main' END END",
        "''::VARCHAR AS target ;; FALSE AS busy", "'refetch' ;; target ;; TRUE ;; NULL::BIGINT",
        f"CASE WHEN {_DONE} THEN CASE WHEN busy THEN {_NAME} ELSE 'ignored' END WHEN {_NEW} THEN 'reset' WHEN busy THEN 'busy' WHEN due IS NOT NULL THEN 'wait' ELSE 'fetch' END ;; CASE WHEN {_DONE} THEN target ELSE {_NAME} END ;; "
        f"CASE WHEN {_DONE} THEN FALSE ELSE {_NEW} OR busy OR due IS NULL END ;; CASE WHEN {_DONE} THEN CASE WHEN busy THEN x_ts + {_AFTER} ELSE due END WHEN {_NEW} THEN NULL ELSE due END"),
    "expiry_stream": _machine(
        "CASE WHEN event_type = 'purchase' THEN 'press' ELSE 'tick' END", "FALSE AS shown", "'expired' ;; FALSE ;; NULL::BIGINT",
        f"CASE WHEN x = 'press' THEN CASE WHEN shown THEN 'again' ELSE 'shown' END WHEN shown THEN 'on' ELSE 'off' END ;; x = 'press' OR shown ;; CASE WHEN x = 'press' THEN x_ts + {3 * UNIT} ELSE due END"),
    "turns_stream": _machine(
        "CASE event_type WHEN 'signup' THEN 'start' WHEN 'purchase' THEN 'end' WHEN 'click' THEN 'tool' WHEN 'view' THEN 'block:' || CAST(floor(value) AS BIGINT) % 9 ELSE 'question:' || CAST(floor(value) AS BIGINT) % 9 END",
        "NULL::BIGINT AS turn ;; FALSE AS running ;; []::BIGINT[] AS tools ;; MAP {}::MAP(VARCHAR, BIGINT) AS seen", "'idle' ;; NULL::BIGINT ;; FALSE ;; []::BIGINT[] ;; seen ;; NULL::BIGINT",
        f"CASE WHEN x = 'start' THEN 'start' WHEN x = 'end' THEN CASE WHEN running THEN 'end' ELSE 'no turn' END WHEN x = 'tool' THEN 'tools:' || array_to_string(list_append(tools, x_id), '+') WHEN starts_with(x, 'question') THEN CASE WHEN {_KNOWN} THEN 'seen' ELSE 'new' END ELSE 'group:' || CASE WHEN {_KNOWN} THEN seen[x] ELSE {_OWN} END END ;; "
        f"CASE WHEN x = 'start' THEN x_id WHEN x = 'end' THEN NULL ELSE turn END ;; x = 'start' OR x <> 'end' AND running ;; CASE WHEN x IN ('start', 'end') THEN []::BIGINT[] WHEN x = 'tool' THEN list_append(tools, x_id) ELSE tools END ;; "
        f"CASE WHEN contains(x, ':') AND NOT {_KNOWN} THEN map_concat(seen, MAP {{x: {_OWN}}}) ELSE seen END ;; CASE WHEN x = 'start' OR x <> 'end' AND running THEN x_ts + {IDLE} END"),
}
