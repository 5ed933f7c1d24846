"""Queries over journals and logs that are written to files and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..sources import corpus, journals, store

_LINE = """to_json(named_struct('type', role, 'timestamp', date_format(timestamp_seconds(ts), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"), 'cwd', concat('/home/u/', project),
 'origin', named_struct('kind', IF(file % 5 = 0, 'task', 'human')), 'promptSource', IF(turn % 7 = 6, 'queued', 'typed'), 'message', named_struct('content', 'hello')))"""


def _lines(spark, sf_dir) -> DataFrame:
    """The conversations as journal lines; some users' contents and all answers' are lists, and some lines are damaged."""
    s = corpus.table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("file"), "turn", (F.lit(1704067200) + F.col("conv_id") * 3600 + F.col("turn") * 60).alias("ts"), F.concat(F.lit("p"), (F.col("conv_id") % 7).cast("string")).alias("project"), "role")
    item = F.when(F.col("turn") % 3 == 0, "thinking").when(F.col("turn") % 3 == 1, "text").otherwise("tool_use")
    listed = F.concat(F.lit('"content":[{"type":"'), item, F.lit('"}]'))
    line = F.expr(_LINE)
    line = F.when((F.col("role") == "assistant") | (F.col("file") % 9 == 0), F.replace(line, F.lit('"content":"hello"'), listed)).otherwise(line)
    return s.select("project", "file", F.when((F.col("file") + F.col("turn")) % 31 == 0, F.substring(line, 1, 20)).otherwise(line).alias("line"))


def _written(spark, sf_dir) -> str:
    path = store.fresh(spark, "sessions")
    _lines(spark, sf_dir).repartition("project", "file").write.partitionBy("project", "file").text(path)
    return path


def session_jsonl_qualify(spark, sf_dir) -> DataFrame:
    """Journals with a typed line and an answer in a Japanese day: first and last time, project from the working folder, ordered by start."""
    rows = journals.read_sessions(spark, _written(spark, sf_dir)).select(F.regexp_extract("file", "/file=([0-9]+)/", 1).cast("long").alias("file"), journals.parsed(F.col("line")).alias("v")).where("v IS NOT NULL")
    low, high = (F.date_format(F.timestamp_seconds(x), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'") for x in text.jst_window(F.lit("2024-01-02")))
    at = F.try_variant_get("v", "$.timestamp", "string")
    inside = rows.withColumn("at", at).where((F.col("at") >= low) & (F.col("at") < high))
    per = inside.groupBy("file").agg(F.bool_or(journals.is_human(F.col("v"))).alias("a"), F.bool_or(journals.is_reply(F.col("v"))).alias("b"), F.min("at").alias("start"), F.max("at").alias("end"), F.min_by(F.try_variant_get("v", "$.cwd", "string"), "at").alias("cwd"))
    return per.where("a AND b").select("file", "start", "end", text.basename(F.col("cwd")).alias("project")).orderBy("start", "file")


def session_jsonl_sizes(spark, sf_dir) -> DataFrame:
    """Journals of a least size, pruned by the files' own data."""
    rows = journals.read_sessions(spark, _written(spark, sf_dir), F.lit("2000-01-01").cast("timestamp"), 700)
    return rows.groupBy(F.regexp_extract("file", "/file=([0-9]+)/", 1).cast("long").alias("file")).agg(F.max("size").alias("size"), F.count("*").alias("lines"))


def session_timeline(spark, sf_dir) -> DataFrame:
    """All sessions by their start."""
    s = corpus.sessions(spark, sf_dir).groupBy("file", "project").agg(F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts"))
    return s.orderBy("start_ts", "file")


_RECORD = "event_id long, tool_name string, pattern string"


def _log(spark, sf_dir) -> str:
    path = store.fresh(spark, "failures")
    journals.append(corpus.failures(spark, sf_dir).select("event_id", "tool_name", "pattern", "dt"), path)
    return path


def failure_log_period(spark, sf_dir) -> DataFrame:
    """The last seven days of the written log, by tool."""
    return journals.read_log(spark, _log(spark, sf_dir), _RECORD, 7, "20240127").groupBy("dt", "tool_name").agg(F.count("*").alias("n"))


def failure_log_delete(spark, sf_dir) -> DataFrame:
    """The written log after one exact day is deleted; a relative date deletes nothing."""
    path = _log(spark, sf_dir)
    for day in ("20240103", "yesterday", "2024010"):
        journals.delete_day(spark, path, day)
    return spark.read.schema(_RECORD + ", dt string").json(path).groupBy("dt").agg(F.count("*").alias("n"))


def failure_log_stream(spark, sf_dir) -> DataFrame:
    """Events read as a stream, their failures appended to the daily log, the log read back."""
    events = spark.readStream.schema(corpus.table(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/events*.parquet")
    path = store.fresh(spark, "stream")
    journals.append_stream(corpus.as_failures(events), path + "/log", path + "/checkpoint")
    return spark.read.schema(_RECORD + ", dt string").json(path + "/log").groupBy("dt", "tool_name").agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"))


_S = """s AS (SELECT conv_id AS file, turn, role, 1704067200 + conv_id * 3600 + turn * 60 AS ts, 'p' || (conv_id % 7) AS project FROM conversations),
l AS (SELECT file, project, json_object('type', role, 'timestamp', strftime(make_timestamp(CAST(ts AS BIGINT) * 1000000), '%Y-%m-%dT%H:%M:%S.000Z'), 'cwd', '/home/u/' || project, 'origin', json_object('kind', CASE WHEN file % 5 = 0 THEN 'task' ELSE 'human' END),
  'promptSource', CASE WHEN turn % 7 = 6 THEN 'queued' ELSE 'typed' END, 'message', json_object('content', CASE WHEN role = 'assistant' OR file % 9 = 0
    THEN json_array(json_object('type', CASE turn % 3 WHEN 0 THEN 'thinking' WHEN 1 THEN 'text' ELSE 'tool_use' END)) ELSE to_json('hello') END))::VARCHAR AS line, (file + turn) % 31 = 0 AS damaged FROM s)"""
_F = "f AS (SELECT event_id, 'tool' || (user_id % 7) AS tool_name, strftime(ts, '%Y%m%d') AS dt FROM events WHERE event_type = 'error')"
QUERIES = {f.__name__: f for f in (session_jsonl_qualify, session_jsonl_sizes, session_timeline, failure_log_period, failure_log_delete, failure_log_stream)}
ORACLES = {
    "session_jsonl_qualify": f"""WITH {_S}, v AS (SELECT file, line, json_extract_string(line, '$.timestamp') AS at1, json_extract_string(line, '$.type') AS kind, json_type(line, '$.message.content') AS shape FROM l WHERE NOT damaged),
g AS (SELECT file, min(at1) AS start, max(at1) AS "end", min_by(json_extract_string(line, '$.cwd'), at1) AS cwd,
  bool_or(kind = 'user' AND shape = 'VARCHAR' AND json_extract_string(line, '$.origin.kind') = 'human' AND json_extract_string(line, '$.promptSource') = 'typed') AS a,
  bool_or(kind = 'assistant' AND shape = 'ARRAY' AND json_extract_string(line, '$.message.content[0].type') IN ('text', 'tool_use')) AS b
  FROM v WHERE at1 >= '2024-01-01T15:00:00.000Z' AND at1 < '2024-01-02T15:00:00.000Z' GROUP BY file)
SELECT file, start, "end", regexp_extract(cwd, '[^/]+$') AS project FROM g WHERE a AND b""",
    "session_jsonl_sizes": f"WITH {_S} SELECT file, CAST(sum(1 + CASE WHEN damaged THEN 20 ELSE strlen(line) END) AS BIGINT) AS size, count(*) AS lines FROM l GROUP BY file HAVING size >= 700",
    "session_timeline": f"WITH {_S} SELECT file, project, min(ts) AS start_ts, max(ts) AS end_ts FROM s GROUP BY file, project",
    "failure_log_period": f"WITH {_F} SELECT dt, tool_name, count(*) AS n FROM f WHERE dt BETWEEN '20240121' AND '20240127' GROUP BY ALL",
    "failure_log_delete": f"WITH {_F} SELECT dt, count(*) AS n FROM f WHERE dt <> '20240103' GROUP BY dt",
    "failure_log_stream": f"WITH {_F} SELECT dt, tool_name, count(*) AS n, min(event_id) AS first_id FROM f GROUP BY ALL",
}
