"""Pages, text functions and event state."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import html, markdown, text
from ..sources import corpus


def _pages(spark, sf_dir):
    return corpus.table(spark, sf_dir, "pages")


def page_robots_url(spark, sf_dir):
    return _pages(spark, sf_dir).select("page_id", text.robots_url(F.col("url")).alias("robots_url"))


def page_html_sniff(spark, sf_dir):
    return _pages(spark, sf_dir).select("page_id", text.looks_html(F.col("html"), F.lit("text/plain")).alias("is_html"))


def page_size_guard(spark, sf_dir):
    return _pages(spark, sf_dir).select("page_id", text.size_guard(F.col("html"), 5000).alias("guard"))


def page_main_content(spark, sf_dir):
    return _pages(spark, sf_dir).select("page_id", html.main_content("html").alias("markdown"))


def page_main_words(spark, sf_dir):
    """How many words the main content of each page has, and what they are."""
    words = F.split(html.main_text("html"), " ")
    return _pages(spark, sf_dir).select("page_id", F.size(words).alias("n_words"), F.sha2(F.array_join(words, " "), 256).alias("words_sha256"))


def page_full_markdown(spark, sf_dir):
    return _pages(spark, sf_dir).select("page_id", html.full_markdown("html").alias("markdown"))


def nonempty_lines(spark, sf_dir):
    d = corpus.table(spark, sf_dir, "documents")
    return d.select("doc_id", text.nonempty_lines(F.col("text")).alias("n"))


def path_basename(spark, sf_dir):
    return corpus.files(spark, sf_dir).select("file_id", text.basename(F.col("path")).alias("name"))


def level_color(spark, sf_dir):
    e = corpus.table(spark, sf_dir, "events").select("event_id", F.col("value").alias("v"))
    return e.select("event_id", text.rounded(F.col("v")).alias("shown"), text.level(F.col("v")).alias("color"))


def split_message_parts(spark, sf_dir):
    """The parts of each document, some of which get a table and a code block."""
    d = corpus.table(spark, sf_dir, "documents").where("text IS NOT NULL")
    more = F.when(F.col("doc_id") % 3 == 0, F.lit("\n\n| a | b |\n| --- | :-: |\n| 1 | \\| |\n\n```py\nx = 1\n```\n")).otherwise("")
    flat = F.translate("text", "|`~\n\r", "     ")
    return markdown.parts_of(d.select("doc_id", F.concat(flat, more).alias("text")), "doc_id").select("doc_id", "ord", "kind", F.length("part").alias("n_chars"))


def _events(spark, sf_dir):
    return corpus.table(spark, sf_dir, "events").select("event_id", "user_id", F.unix_timestamp(F.col("ts").cast("timestamp")).alias("ts"), "event_type", "value")


def latest_value_state(spark, sf_dir):
    e = _events(spark, sf_dir)
    return e.groupBy("user_id").agg(F.max_by("value", F.struct("ts", "event_id")).alias("value"))


def ring_buffer_last2(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    return _events(spark, sf_dir).withColumn("back", F.row_number().over(w)).where("back <= 2").select("user_id", "back", "event_id")


def dedup_first_seen(spark, sf_dir):
    return _events(spark, sf_dir).groupBy("user_id", "event_type").agg(F.min_by("event_id", F.struct("ts", "event_id")).alias("event_id"))


def turn_assignment(spark, sf_dir):
    """Each event's group: the turn that runs (the last sign-up or purchase of its user so far), or itself before the first."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    start = F.when(F.col("event_type").isin("signup", "purchase"), F.col("event_id"))
    return _events(spark, sf_dir).select("event_id", F.coalesce(F.last(start, True).over(w), "event_id").alias("turn_id"))


def key_change_detection(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = _events(spark, sf_dir).withColumn("before", F.lag("event_type").over(w))
    return e.where("before IS NULL OR before <> event_type").groupBy("user_id").agg(F.count("*").alias("changes"))


def fold_groups(spark, sf_dir):
    g = corpus.table(spark, sf_dir, "conversations").withColumn("n", text.nonempty_lines(F.col("text")))
    return g.groupBy("conv_id").agg(F.sum("n").alias("lines"), (F.sum("n") > 1).alias("foldable"))


_E = "e AS (SELECT event_id, user_id, CAST(epoch(ts) AS BIGINT) AS ts, event_type, value FROM events)"
_NAMES = """page_robots_url page_html_sniff page_size_guard page_main_content page_main_words page_full_markdown nonempty_lines path_basename
level_color split_message_parts latest_value_state ring_buffer_last2
dedup_first_seen turn_assignment key_change_detection fold_groups"""
QUERIES = {n: globals()[n] for n in _NAMES.split()}
ORACLES = {
    "split_message_parts": """WITH d AS (SELECT doc_id, regexp_replace(translate(text, '|`~' || chr(10) || chr(13), '     '), '^\\s+$', '') AS t FROM documents WHERE text IS NOT NULL)
SELECT doc_id, 0 AS ord, 'plain' AS kind, CAST(length(t) AS INTEGER) AS n_chars FROM d WHERE t <> '' UNION ALL
SELECT doc_id, CASE WHEN t <> '' THEN 1 ELSE 0 END + k, (['table', 'code'])[k + 1], ([34, 5])[k + 1] FROM d, range(2) r(k) WHERE doc_id % 3 = 0""",
    "page_robots_url": "SELECT page_id, regexp_extract(url, '^([a-z]+://[^/?#]+)', 1) || '/robots.txt' AS robots_url FROM pages",
    "page_html_sniff": "SELECT page_id, contains(substr(html, 1, 100), '<html') AS is_html FROM pages",
    "page_size_guard": "SELECT page_id, CASE WHEN length(html) > 5000 THEN 'error' ELSE 'ok' END AS guard FROM pages",
    "page_main_words": r"""WITH a AS (SELECT page_id, regexp_extract(html, '(?s)<article>(.*?)</article>', 1) AS a FROM pages),
w AS (SELECT page_id, list_filter(regexp_split_to_array(replace(replace(replace(replace(regexp_replace(a, '<[^>]+>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&'), '\s+'), lambda x: x <> '') AS w FROM a)
SELECT page_id, CAST(len(w) AS INTEGER) AS n_words, sha256(array_to_string(w, ' ')) AS words_sha256 FROM w""",
    "nonempty_lines": "SELECT doc_id, CAST(len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '\\S'))) AS INTEGER) AS n FROM documents",
    "path_basename": "SELECT doc_id AS file_id, doc_id || CASE lang WHEN 'en' THEN '.md' WHEN 'fr' THEN '.txt' WHEN 'de' THEN '.pdf' ELSE '.docx' END AS name FROM documents",
    "level_color": f"WITH {_E} SELECT event_id, CAST(floor(value + 0.5) AS BIGINT) AS shown, CASE WHEN value >= 80 THEN 'danger' WHEN value >= 50 THEN 'warn' ELSE 'normal' END AS color FROM e",
    "latest_value_state": f"WITH {_E} SELECT user_id, value FROM e QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1",
    "ring_buffer_last2": f"WITH {_E}, r AS (SELECT user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS INTEGER) AS back, event_id FROM e) SELECT * FROM r WHERE back <= 2",
    "dedup_first_seen": f"WITH {_E} SELECT user_id, event_type, event_id FROM e QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) = 1",
    "turn_assignment": f"WITH {_E} SELECT event_id, coalesce(last_value(CASE WHEN event_type IN ('signup', 'purchase') THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), event_id) AS turn_id FROM e",
    "key_change_detection": f"WITH {_E}, l AS (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM e) SELECT user_id, count(*) AS changes FROM l WHERE b IS NULL OR b <> event_type GROUP BY user_id",
    "fold_groups": "SELECT conv_id, CAST(sum(n) AS BIGINT) AS lines, sum(n) > 1 AS foldable FROM (SELECT conv_id, len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '\\S'))) AS n FROM conversations) GROUP BY conv_id",
}
