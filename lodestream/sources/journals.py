"""Line-oriented logs: session journals (JSON lines in folders) and a failure log of one folder a day."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_sessions(spark: SparkSession, root: str, since: Column | None = None, least: int = 0) -> DataFrame:
    """file, size and line of the journals two folders below root; conditions on time and size of a file reach the listing."""
    rows = spark.read.text(f"{root}/*/*/*.txt").select(F.col("value").alias("line"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("size"), F.col("_metadata.file_modification_time").alias("modified"))
    if since is not None:
        rows = rows.where(F.col("modified") >= since)
    return rows.where(F.col("size") >= least) if least else rows


def parsed(line: Column) -> Column:
    """The line's object as a variant; null for what is no JSON object with a text timestamp."""
    v = F.try_parse_json(line)
    good = F.schema_of_variant(v).startswith("OBJECT") & (F.schema_of_variant(F.try_variant_get(v, "$.timestamp", "variant")) == "STRING")
    return F.when(good, v)


def _text(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "string")


def is_human(v: Column) -> Column:
    """A line that a person typed: its content is a text, not a list."""
    content = F.schema_of_variant(F.try_variant_get(v, "$.message.content", "variant"))
    return F.coalesce((_text(v, "$.type") == "user") & (content == "STRING") & (_text(v, "$.origin.kind") == "human") & (_text(v, "$.promptSource") == "typed"), F.lit(False))


def is_reply(v: Column) -> Column:
    """An answer: its content is a list with a text or a use of a tool."""
    items = F.try_variant_get(v, "$.message.content", "array<variant>")
    return F.coalesce((_text(v, "$.type") == "assistant") & F.exists(items, lambda x: _text(x, "$.type").isin("text", "tool_use")), F.lit(False))


def append(failures: DataFrame, path: str) -> None:
    """Adds failure records (with dt) to the log, a folder for each day."""
    failures.write.mode("append").partitionBy("dt").json(path)


def append_stream(failures: DataFrame, path: str, checkpoint: str) -> None:
    """The same for a stream, until all that is there now has been read; each record arrives once, whatever restarts."""
    q = failures.writeStream.format("json").partitionBy("dt").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()


def read_log(spark: SparkSession, path: str, schema: str, period: str | int = 7, today: str | None = None) -> DataFrame:
    """The records of one day (eight digits) or of the last days up to today; only these days' folders are read."""
    rows = spark.read.schema(schema + ", dt string").json(path)
    if re.fullmatch("[0-9]{8}", str(period)):
        return rows.where(F.col("dt") == str(period))
    first = F.date_format(F.date_sub(F.to_date(F.lit(today), "yyyyMMdd"), int(period) - 1), "yyyyMMdd")
    return rows.where((F.col("dt") >= first) & (F.col("dt") <= today))


def delete_day(spark: SparkSession, path: str, day: str) -> bool:
    """Deletes one day's folder, or all days for "all"; False for anything else."""
    if day != "all" and not re.fullmatch("[0-9]{8}", day):
        return False
    p = spark._jvm.org.apache.hadoop.fs.Path(path if day == "all" else f"{path}/dt={day}")
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
