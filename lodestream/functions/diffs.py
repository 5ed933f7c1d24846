"""File and line numbers of what reviewers read: diffs, listings with numbers, and one after the other."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: A listed line: number and text, with its file before it or not; a diff's own lines begin with none of these.
LISTED = r"^(?:([^\s:+@\\-][^:]*):)?([0-9]+):"


def places(lines: DataFrame) -> DataFrame:
    """key, n, file and line_no of the lines of inputs (key, n, line, path), in the order of n; an input's lines are one task's work.

    In a diff the file is that of the last "+++ b/" and a number counts from the last hunk's start over
    added and unchanged lines; deleted ones have none. A listed line tells its own number, and its
    file or else the path that was asked for; after the first of them only another "diff --git"
    begins a diff. Lines that are neither have no row.
    """
    w = Window.partitionBy("key").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    line = F.col("line")
    head, listed, hunk = line.startswith("diff --git "), line.rlike(LISTED), line.rlike(r"^@@ -\S+ \+[0-9]+")
    mode = F.last(F.when(head, "diff").when(listed, "list"), True).over(w)
    named = F.when(head, "").when(line.startswith("+++ b/"), F.substring(line, 7, 1 << 20))
    own = lines.select("key", "n", "line", "path", mode.alias("mode"), F.last(named, True).over(w).alias("of"), (head | hunk).alias("begins"), F.last(F.when(head, -1).when(hunk, F.regexp_extract(line, r"^@@ -\S+ \+([0-9]+)", 1).cast("int")), True).over(w).alias("start"))
    counts = (F.col("mode") == "diff") & F.col("line").rlike("^[ +]") & ~F.col("line").startswith("+++ ") & (F.col("start") >= 0)
    # Lines counted so far, without those before the hunk, so that one sort serves all windows.
    own = own.withColumn("counts", F.coalesce(counts, F.lit(False))).withColumn("so_far", F.count_if("counts").over(w))
    own = own.withColumn("earlier", F.coalesce(F.last(F.when(F.col("begins"), F.col("so_far")), True).over(w), F.lit(0)))
    counts = F.col("counts")
    number = F.when(counts, F.col("start") + F.col("so_far") - F.col("earlier") - 1).when(F.col("line").rlike(LISTED), F.regexp_extract("line", LISTED, 2).try_cast("long"))
    file = F.when(counts, F.col("of")).otherwise(F.coalesce(F.nullif(F.regexp_extract("line", LISTED, 1), F.lit("")), "path"))
    return own.select("key", "n", file.alias("file"), number.cast("long").alias("line_no")).where("line_no IS NOT NULL")
