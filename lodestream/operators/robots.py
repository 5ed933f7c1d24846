"""Rules of robots files as tables, joined with addresses: agent groups, wildcards, the longest rule wins.

Lines that are a comment as a whole are left out, and what follows a # in another. Agents named one
after the other share the rules below. An agent takes the group with the longest name that it
begins with, whatever the case, else the group for all, else anything goes. A pattern holds from the
beginning of the path (with its query): * stands for any text, $ at the end for the end; the pattern
with the most letters decides, and of equal ones the one that allows. An empty pattern says nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _regex(pattern: Column) -> Column:
    escaped = F.regexp_replace(pattern, r"([\\.+?^${}()|\[\]])", r"\\$1")
    return F.concat(F.lit("(?s)^"), F.regexp_replace(F.regexp_replace(escaped, r"\*+", ".*"), r"\\\$$", r"\$"))


def rules_of(files: DataFrame) -> DataFrame:
    """host, agent (lower case), allow, size and regex of robots files (host, body); a row without regex for each agent that is named."""
    line = files.select("host", F.posexplode(F.split("body", "\r\n|\r|\n")).alias("n", "line")).where("NOT ltrim(line) LIKE '#%'")
    part = line.select("host", "n", F.lower(F.trim(F.regexp_extract("line", "^([^:#]*):", 1))).alias("field"), F.trim(F.regexp_extract("line", "^[^:#]*:([^#]*)", 1)).alias("value"))
    part = part.where(F.col("field").isin("user-agent", "allow", "disallow"))
    w = Window.partitionBy("host").orderBy("n")
    named = F.col("field") == "user-agent"
    part = part.withColumn("opens", named & ~F.coalesce(F.lag(named).over(w), F.lit(False)))
    part = part.withColumn("block", F.count_if("opens").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    agents = part.where(named).select("host", "block", F.lower("value").alias("agent"))
    rules = part.where(~named & (F.col("value") != "")).select("host", "block", (F.col("field") == "allow").alias("allow"), F.length("value").alias("size"), _regex(F.col("value")).alias("regex"))
    return agents.join(rules, ["host", "block"], "left").select("host", "agent", "allow", "size", "regex")


def decided(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """id and allowed for rows of id, url and agent."""
    own = urls.select("id", F.parse_url("url", F.lit("HOST")).alias("host"), F.lower("agent").alias("own"), F.regexp_replace(F.regexp_replace("url", "^[^:/?#]+://[^/?#]*", ""), "#.*$", "").alias("path"))
    own = own.withColumn("path", F.when(F.col("path").startswith("/"), F.col("path")).otherwise(F.concat(F.lit("/"), "path")))
    # The group of each agent at each host is looked up once, not for every address.
    names = rules.select("host", "agent").distinct()
    pairs = own.select("host", "own").distinct().join(names, "host").where((F.col("agent") == "*") | F.col("own").startswith(F.col("agent")))
    group = pairs.groupBy("host", "own").agg(F.max_by("agent", F.when(F.col("agent") == "*", -1).otherwise(F.length("agent"))).alias("agent"))
    held = own.join(group, ["host", "own"], "left")
    met = held.join(rules.where("regex IS NOT NULL"), ["host", "agent"]).where(F.expr("path RLIKE regex"))
    best = met.groupBy("id").agg(F.max(F.struct("size", "allow")).alias("best"))
    return own.select("id").join(best, "id", "left").select("id", F.coalesce("best.allow", F.lit(True)).alias("allowed"))
