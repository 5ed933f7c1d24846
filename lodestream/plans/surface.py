"""Encoders, judges, the page tool, event routes, turns, and labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import html, text
from ..operators import encoders, vector
from ..sources import corpus
from . import build
from .search import _FILES


def encoder_search(spark, sf_dir) -> DataFrame:
    """The ten chunks nearest to a query, both encoded by a pluggable encoder, the chunks once, when the index is built."""
    query = encoders.query_vector("the night sea", encoders.LetterEncoder())
    near = vector.nearest_stored(_indexed(spark, sf_dir), query, 10)
    return near.select("rank", "chunk_id", "path", "start_line", F.round(vector.similarity(F.col("distance")), 4).alias("score"))


def _indexed(spark, sf_dir):
    return corpus.index(spark, sf_dir, build.encoding(encoders.LetterEncoder))


def semantic_batch(spark, sf_dir) -> DataFrame:
    """The five chunks nearest to each benchmark text, all texts at once against the stored vectors."""
    asked = corpus.table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("long").alias("query_id"), encoders.encoded(F.col("text"), encoders.LetterEncoder).alias("embedding"))
    return vector.nearest_batch(_indexed(spark, sf_dir).snapshot.vectors(spark), asked.where(vector.norm(F.col("embedding")) > 0), 5)


def agent_answers(spark, sf_dir) -> DataFrame:
    """An agent's structured answers to whole texts; those that are no JSON are null."""
    d = corpus.table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("prompt"))
    out = encoders.judged(d, F.col("prompt"), encoders.letters_judge, "answers boolean, confidence int")
    return out.select("doc_id", "answer.answers", "answer.confidence")


def parallel_map_batches(spark, sf_dir) -> DataFrame:
    """Words of each conversation turn, worked on ten parts at a time; turns of fewer than four words give null and go."""

    def count(rows):
        n = rows.text.str.split(" ").map(len)
        return rows[["conv_id", "turn"]].assign(n=n.where(n >= 4).astype("Int64"))

    return encoders.parallel_map(corpus.table(spark, sf_dir, "conversations").select("conv_id", "turn", "text"), count, "conv_id long, turn int, n long")


def fetch(pages: DataFrame, raw: bool = False, force_full: bool = False, extract: bool = True, most: int = 200_000) -> DataFrame:
    """page_id, kind and content of pages (page_id, html, content_type): main content or whole document as Markdown, or as it is; too much is an error unless forced."""
    is_html = text.looks_html(F.col("html"), F.col("content_type"))
    body = F.col("html") if raw else F.when(is_html, html.main_content("html") if extract else html.full_markdown("html")).otherwise(F.col("html"))
    kind = F.when(~is_html, "raw").otherwise("raw" if raw else "markdown")
    out = pages.select("page_id", kind.alias("kind"), body.alias("content"))
    guard = text.size_guard(F.col("content"), most, force_full)
    return out.select("page_id", F.when(guard == "error", "error").otherwise(F.col("kind")).alias("kind"), F.when(guard == "error", F.concat(F.lit("too long: "), F.length("content").cast("string"))).otherwise(F.col("content")).alias("content"))


def page_fetch_raw(spark, sf_dir) -> DataFrame:
    kind = F.when(F.col("page_id") % 3 == 0, "text/plain").when(F.col("page_id") % 3 == 1, "text/html; charset=utf-8")
    pages = corpus.table(spark, sf_dir, "pages").select("page_id", "html", kind.alias("content_type"))
    return fetch(pages, raw=True, most=3000).select("page_id", "kind", F.sha2("content", 256).alias("content_sha256"))


def page_status(spark, sf_dir) -> DataFrame:
    """Pages with the status of their answer: 400 and above is an error without content."""
    p = corpus.table(spark, sf_dir, "pages").select("page_id", "html", F.element_at(F.array(*map(F.lit, (200, 200, 301, 404, 500))), (F.col("page_id") % 5 + 1).cast("int")).alias("status"))
    return p.select("page_id", F.when(F.col("status") >= 400, F.concat(F.lit("HTTP "), F.col("status").cast("string"))).alias("error"), F.when(F.col("status") < 400, F.length("html")).alias("length"))


# Which handler takes an event, from which agent, and which changed fields it needs.
ROUTES = [("signup", "restart", True, None), ("purchase", "sync_cost", True, None), ("view", "sync_context", True, "even"), ("view", "count_views", False, None), ("click", "toggle", False, "odd"), ("error", "log", False, None)]


def event_routes(spark, sf_dir) -> DataFrame:
    """Events by handler: a handler may take the main agent's events alone, or those that changed what it shows."""
    table = spark.createDataFrame(ROUTES, "event_type string, handler string, main_only boolean, needs string")
    e = corpus.table(spark, sf_dir, "events").select("event_id", "event_type", (F.col("user_id") % 4 != 0).alias("is_main"), F.when(F.col("event_id") % 2 == 0, "even").otherwise("odd").alias("changed"))
    hit = e.join(F.broadcast(table), "event_type").where((~F.col("main_only") | F.col("is_main")) & (F.col("needs").isNull() | (F.col("needs") == F.col("changed"))))
    return hit.groupBy("handler").agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"), F.max("event_id").alias("last_id"))


def turn_lifecycle(spark, sf_dir) -> DataFrame:
    """After each event: whether the turn runs, the tools called in it, and whether any turn has ended. A sign-up starts a turn, a purchase ends it, clicks call a tool."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = corpus.table(spark, sf_dir, "events").select("event_id", "user_id", F.unix_timestamp(F.col("ts").cast("timestamp")).alias("ts"), "event_type")
    turn = F.count_if(F.col("event_type").isin("signup", "purchase"))
    e = e.withColumn("turn", turn.over(w)).withColumn("edge", F.last(F.when(F.col("event_type").isin("signup", "purchase"), F.col("event_type")), True).over(w))
    t = Window.partitionBy("user_id", "turn").orderBy("ts", "event_id")
    return e.select("event_id", F.coalesce(F.col("edge") == "signup", F.lit(False)).alias("running"), F.count_if(F.col("event_type") == "click").over(t).alias("tools"), F.coalesce(F.bool_or(F.col("event_type") == "purchase").over(w), F.lit(False)).alias("has_ended"))


def turn_notices(spark, sf_dir) -> DataFrame:
    """What is shown after each event, which draws one of its user's five agent rows: tools of the running turn, the row while a turn runs unless it was drawn before an end, notices unless a turn has ended and none runs."""
    e = corpus.table(spark, sf_dir, "events").select("event_id", "user_id", F.unix_timestamp(F.col("ts").cast("timestamp")).alias("ts"), "event_type", (F.floor("value") % 5).alias("row"))
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = e.withColumn("n", F.row_number().over(w))
    e = e.withColumn("ended", F.last(F.when(F.col("event_type") == "purchase", F.col("n")), True).over(w)).withColumn("drawn", F.min("n").over(Window.partitionBy("user_id", "row")))
    t = turn_lifecycle(spark, sf_dir).join(e.select("event_id", F.coalesce(F.col("drawn") < F.col("ended"), F.lit(False)).alias("old")), "event_id")
    return t.select("event_id", (F.col("tools") > 0).alias("tool_group_shown"), (F.col("running") & ~F.col("old")).alias("agent_row_shown"), (~F.col("has_ended") | F.col("running")).alias("notice_shown"))


def reset_clock(spark, sf_dir) -> DataFrame:
    """When a limit resets: the clock for the short window, date and clock for the long one."""
    e = corpus.table(spark, sf_dir, "events")
    return e.select("event_id", F.when(F.col("event_id") % 2 == 0, F.date_format("ts", "HH:mm")).otherwise(F.date_format("ts", "MM/dd HH:mm")).alias("resets"))


def name_color(spark, sf_dir) -> DataFrame:
    """The colour of the first pattern that a name matches, in any case."""
    rules = (("brass", "green"), ("nickel|tin", "yellow"), ("steel$", "red"))
    p = corpus.table(spark, sf_dir, "part")
    c = F.lit(None).cast("string")
    for pattern, color in reversed(rules):
        c = F.when(F.col("p_type").rlike(f"(?i){pattern}"), color).otherwise(c)
    return p.select("p_partkey", F.coalesce(c, F.lit("blue")).alias("color"))


def map_updates(spark, sf_dir) -> DataFrame:
    """Maps with an entry set anew (and last), one deleted, and the oldest beyond three dropped."""
    l = corpus.table(spark, sf_dir, "orders").select("o_orderkey", *(F.concat(F.lit(k), (F.col("o_orderkey") % m).cast("string")).alias(k) for k, m in (("a", 2), ("b", 3), ("c", 2), ("d", 5))))
    held = F.map_from_arrays(F.array("a", "b", "c", "d"), F.array(*map(F.lit, (1, 2, 3, 4))))
    again = F.map_concat(F.map_filter(held, lambda k, _: k != F.col("b")), F.create_map("b", F.lit(9)))
    left = F.map_filter(again, lambda k, _: k != "d0")
    entries = F.map_entries(left)
    capped = F.slice(entries, F.greatest(F.size(entries) - 2, F.lit(1)), 3)
    return l.select("o_orderkey", F.array_join(F.transform(capped, lambda e: F.concat_ws("=", e.key, e.value.cast("string"))), ",").alias("entries"))


# Labels of a button and indicators of a reload, by kind and result.
LABELS = {("table", "idle"): "COPY TABLE", ("table", "success"): "TABLE COPIED", ("table", "failed"): "COPY FAILED", ("code", "idle"): "COPY CODE", ("code", "success"): "CODE COPIED", ("code", "failed"): "COPY FAILED"}
INDICATORS = {"idle": ("↻", "blue"), "loading": ("…", "yellow"), "done": ("✓", "green"), "failed": ("✗", "red")}


def button_labels(spark, sf_dir) -> DataFrame:
    """The label of each order's button, centred in twenty columns, and the indicator of its state."""
    o = corpus.table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 2 == 0, "table").otherwise("code").alias("kind"), F.element_at(F.array(*map(F.lit, ("idle", "success", "failed"))), (F.col("o_custkey") % 3 + 1).cast("int")).alias("result"), F.element_at(F.array(*map(F.lit, INDICATORS)), (F.col("o_orderkey") % 4 + 1).cast("int")).alias("state"))
    labels = spark.createDataFrame([(*k, v) for k, v in LABELS.items()], "kind string, result string, label string")
    icons = spark.createDataFrame([(k, *v) for k, v in INDICATORS.items()], "state string, icon string, color string")
    rows = o.join(F.broadcast(labels), ["kind", "result"]).join(F.broadcast(icons), "state")
    return rows.select("o_orderkey", text.pad_centre(F.col("label"), 20).alias("label"), "icon", "color")


def tool_versions(spark, sf_dir) -> DataFrame:
    """Versions out of what six tools print."""
    p = corpus.table(spark, sf_dir, "part")
    v = F.concat_ws(".", (F.col("p_size") % 30).cast("string"), (F.col("p_partkey") % 20).cast("string"), F.lit("1"))
    shapes = {"node": F.concat(F.lit(" v"), v), "python": F.concat(F.lit("Python "), v), "rust": F.concat(F.lit("rustc "), v, F.lit(" (abc 2024)")), "go": F.concat(F.lit("go version go"), v, F.lit(" linux/amd64")), "bun": F.concat(v, F.lit("-canary\n")), "terraform": F.concat(F.lit("OpenTofu v"), v, F.lit("\non linux"))}
    out = F.lit("none printed")
    kind = F.element_at(F.array(*map(F.lit, shapes)), (F.col("p_partkey") % 6 + 1).cast("int"))
    for k, s in shapes.items():
        out = F.when(kind == k, s).otherwise(out)
    return p.select("p_partkey", kind.alias("tool"), out.alias("printed")).select("p_partkey", "tool", text.tool_version(F.col("tool"), F.col("printed")).alias("version"))


_LETTERS = ", ".join(f"length(text) - length(replace(text, '{c}', ''))" for c in "abcdefghijklmnopqrstuvwxyz")
_UNIT = "list_transform(n, lambda x: (x / sqrt(list_inner_product(n, n)))::FLOAT)"
_QUERY = ", ".join(str("the night sea".count(c)) for c in "abcdefghijklmnopqrstuvwxyz")
_ROUTE_ROWS = ", ".join("(" + ", ".join("NULL" if x is None else f"'{x}'" if isinstance(x, str) else str(x).upper() for x in r) + ")" for r in ROUTES)
_T = """e AS (SELECT event_id, user_id, epoch(ts) AS ts, event_type, event_type IN ('signup', 'purchase') AS edge FROM events),
n AS (SELECT *, sum(edge::INT) OVER w AS turn, last_value(CASE WHEN edge THEN event_type END IGNORE NULLS) OVER w AS state, bool_or(event_type = 'purchase') OVER w AS has_ended FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)),
t AS (SELECT event_id, coalesce(state = 'signup', FALSE) AS running, count(*) FILTER (event_type = 'click') OVER (PARTITION BY user_id, turn ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS tools, has_ended FROM n)"""
QUERIES = {f.__name__: f for f in (encoder_search, semantic_batch, agent_answers, parallel_map_batches, page_fetch_raw, page_status, event_routes, turn_lifecycle, turn_notices, reset_clock, name_color, map_updates, button_labels, tool_versions)}
ORACLES = {
    "encoder_search": f"""WITH RECURSIVE {_FILES}, v AS (SELECT chunk_id, path, start_line, CAST([{_LETTERS}] AS DOUBLE[]) AS e, CAST([{_QUERY}] AS DOUBLE[]) AS q FROM c),
d AS (SELECT chunk_id, path, start_line, list_inner_product(e, q) / sqrt(list_inner_product(e, e)) / sqrt(list_inner_product(q, q)) AS s FROM v WHERE list_inner_product(e, e) > 0)
SELECT CAST(row_number() OVER (ORDER BY s DESC, chunk_id) AS INTEGER) AS rank, chunk_id, path, start_line, round(s, 4) AS score FROM d ORDER BY rank LIMIT 10""",
    "semantic_batch": f"""WITH RECURSIVE {_FILES}, v AS MATERIALIZED (SELECT chunk_id, {_UNIT} AS e FROM (SELECT chunk_id, list_transform({_UNIT}, lambda x: x::DOUBLE) AS n FROM (SELECT chunk_id, [{_LETTERS}]::DOUBLE[] AS n FROM c) WHERE list_inner_product(n, n) > 0)),
q AS (SELECT item_id AS query_id, {_UNIT.replace('::FLOAT', '::DOUBLE')} AS e FROM (SELECT item_id, list_transform({_UNIT}, lambda x: x::DOUBLE) AS n FROM (SELECT item_id, [{_LETTERS}]::DOUBLE[] AS n FROM benchmark) WHERE list_inner_product(n, n) > 0)),
s AS (SELECT query_id, chunk_id, round(greatest(list_inner_product(q.e, list_transform(v.e, lambda x: x::DOUBLE)), 0), 6) AS score FROM q CROSS JOIN v)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS INTEGER) AS rank, chunk_id, score FROM s QUALIFY rank <= 5""",
    "agent_answers": "SELECT doc_id, CASE WHEN n % 11 <> 0 THEN contains(p, 'e') END AS answers, CASE WHEN n % 11 <> 0 THEN CAST(n % 5 AS INTEGER) END AS confidence FROM (SELECT doc_id, coalesce(text, '') AS p, length(coalesce(text, '')) AS n FROM documents)",
    "parallel_map_batches": "SELECT conv_id, turn, CAST(len(string_split(text, ' ')) AS BIGINT) AS n FROM conversations WHERE len(string_split(text, ' ')) >= 4",
    "page_fetch_raw": "SELECT page_id, CASE WHEN length(html) > 3000 THEN 'error' ELSE 'raw' END AS kind, sha256(CASE WHEN length(html) > 3000 THEN 'too long: ' || length(html) ELSE html END) AS content_sha256 FROM pages",
    "page_status": "SELECT page_id, CASE page_id % 5 WHEN 3 THEN 'HTTP 404' WHEN 4 THEN 'HTTP 500' END AS error, CASE WHEN page_id % 5 < 3 THEN CAST(length(html) AS INTEGER) END AS length FROM pages",
    "event_routes": f"WITH r AS (SELECT * FROM (VALUES {_ROUTE_ROWS}) v(event_type, handler, main_only, needs)) SELECT handler, count(*) AS n, min(event_id) AS first_id, max(event_id) AS last_id FROM events JOIN r USING (event_type) WHERE (NOT main_only OR user_id % 4 <> 0) AND (needs IS NULL OR needs = CASE WHEN event_id % 2 = 0 THEN 'even' ELSE 'odd' END) GROUP BY handler",
    "turn_lifecycle": f"WITH {_T} SELECT * FROM t",
    "turn_notices": f"""WITH {_T}, r AS (SELECT event_id, user_id, CAST(floor(value) AS BIGINT) % 5 AS row, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events)
SELECT event_id, tools > 0 AS tool_group_shown, running AND NOT EXISTS (SELECT 1 FROM r x JOIN r z ON z.user_id = x.user_id AND z.event_type = 'purchase' AND z.n > x.n WHERE x.user_id = r.user_id AND x.row = r.row AND z.n <= r.n) AS agent_row_shown, NOT has_ended OR running AS notice_shown FROM t JOIN r USING (event_id)""",
    "reset_clock": "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN strftime(ts, '%H:%M') ELSE strftime(ts, '%m/%d %H:%M') END AS resets FROM events",
    "name_color": "SELECT p_partkey, CASE WHEN regexp_matches(p_type, 'brass', 'i') THEN 'green' WHEN regexp_matches(p_type, 'nickel|tin', 'i') THEN 'yellow' WHEN regexp_matches(p_type, 'steel$', 'i') THEN 'red' ELSE 'blue' END AS color FROM part",
    "map_updates": """WITH m AS (SELECT o_orderkey, ['a' || o_orderkey % 2, 'c' || o_orderkey % 2, 'd' || o_orderkey % 5, 'b' || o_orderkey % 3] AS k, [1, 3, 4, 9] AS v FROM orders),
e AS (SELECT o_orderkey, list_filter(list_transform(range(1, 5), lambda i: CASE WHEN k[i] <> 'd0' THEN k[i] || '=' || v[i] END), lambda x: x IS NOT NULL) AS l FROM m)
SELECT o_orderkey, array_to_string(l[greatest(len(l) - 2, 1):], ',') AS entries FROM e""",
    "button_labels": "WITH b AS (SELECT o_orderkey, CASE o_custkey % 3 WHEN 0 THEN CASE WHEN o_orderkey % 2 = 0 THEN 'COPY TABLE' ELSE 'COPY CODE' END WHEN 1 THEN CASE WHEN o_orderkey % 2 = 0 THEN 'TABLE COPIED' ELSE 'CODE COPIED' END ELSE 'COPY FAILED' END AS l FROM orders) SELECT o_orderkey, repeat(chr(160), CAST((20 - length(l)) // 2 AS INTEGER)) || l || repeat(chr(160), CAST(20 - length(l) - (20 - length(l)) // 2 AS INTEGER)) AS label, (['↻', '…', '✓', '✗'])[o_orderkey % 4 + 1] AS icon, (['blue', 'yellow', 'green', 'red'])[o_orderkey % 4 + 1] AS color FROM b",
    "tool_versions": "SELECT p_partkey, (['node', 'python', 'rust', 'go', 'bun', 'terraform'])[p_partkey % 6 + 1] AS tool, (p_size % 30) || '.' || (p_partkey % 20) || '.1' || CASE WHEN p_partkey % 6 = 4 THEN '-canary' ELSE '' END AS version FROM part",
}
