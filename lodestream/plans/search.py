"""Registered search queries and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.chunking import CHUNKS_SQL
from ..operators import fusion, lexical, vector
from ..sources import corpus


def chunks(spark, sf_dir) -> DataFrame:
    return corpus.chunks(spark, sf_dir)


def query_vector(spark, sf_dir) -> list[float]:
    return corpus.table(spark, sf_dir, "embeddings").where("vec_id = 0").select("embedding").first()[0]


def _fulltext(query: str, **options):
    def run(spark, sf_dir):
        return lexical.search(corpus.index(spark, sf_dir), query, **options).drop("bm25")

    return run


_FILES = f"""{CHUNKS_SQL},
files AS (SELECT doc_id AS file_id, text AS whole, CASE lang WHEN 'en' THEN '.md' WHEN 'fr' THEN '.txt' WHEN 'de' THEN '.pdf' ELSE '.docx' END AS ext, source FROM documents),
c AS MATERIALIZED (SELECT chunk_id, text, ext, start_line, end_line, '/docs/' || source || '/' || file_id || ext AS path,
  CASE WHEN ext IN ('.pdf', '.docx') THEN substr(sha256(whole), 1, 2) || '/' || sha256(whole) || '.txt' ELSE '/docs/' || source || '/' || file_id || ext END AS text_path FROM chunks JOIN files USING (file_id))"""
_FOLD = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _count(p: str) -> str:
    t = "lower(text)"
    if any(p.startswith(p[i:]) for i in range(1, len(p))):
        return f"len(list_filter(range(1, length({t}) - {len(p)} + 2), lambda i: substr({t}, i, {len(p)}) = '{p}'))"
    return f"(length({t}) - length(replace({t}, '{p}', ''))) // {len(p)}"


def _bm25_sql(phrases: list[str], keep: str, every: bool = True, rows: str = _FILES, limit: int = 10, note: str | None = None) -> str:
    n = range(len(phrases))
    terms = " + ".join(f"(CASE WHEN ln((n - df{i} + 0.5::DOUBLE) / (df{i} + 0.5::DOUBLE)) <= 0 THEN 1e-6::DOUBLE ELSE ln((n - df{i} + 0.5::DOUBLE) / (df{i} + 0.5::DOUBLE)) END) * f{i} * 2.2::DOUBLE / (f{i} + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))" for i in n)
    note_sql = f"'{note}'" if note else "CAST(NULL AS VARCHAR)"
    hit = (" AND " if every else " OR ").join(f"f{i} > 0" for i in n)
    return f"""WITH RECURSIVE {rows},
t AS (SELECT *, greatest(length(text) - 2, 0) AS dl, {', '.join(f"{_count(p)} AS f{i}" for i, p in enumerate(phrases))} FROM c),
s AS (SELECT count(*) AS n, avg(dl) AS avgdl, {', '.join(f'count(*) FILTER (f{i} > 0) AS df{i}' for i in n)} FROM t),
best AS (SELECT chunk_id, path, text_path, ext, start_line, end_line, -({terms}) AS bm25 FROM t, s WHERE ({hit}) AND {keep} ORDER BY bm25, chunk_id LIMIT {limit})
SELECT CAST(row_number() OVER (ORDER BY bm25, chunk_id) AS INTEGER) AS rank, chunk_id, path, text_path, ext, start_line, end_line, count(*) OVER () AS total_candidates, {note_sql} AS note,
  round(CASE WHEN min(bm25) OVER () = max(bm25) OVER () THEN 1.0::DOUBLE ELSE (max(bm25) OVER () - bm25) / (max(bm25) OVER () - min(bm25) OVER ()) END, 6) AS score FROM best"""


_CJK_ROWS = [(1, "検索エンジンの設計"), (2, "全文検索と索引"), (3, "天気予報"), (4, "search engine"), (5, "検索エンジン最適化")]


def fulltext_relaxed_cjk(spark, sf_dir):
    rows = spark.createDataFrame(_CJK_ROWS, "chunk_id long, text string").selectExpr("chunk_id", "text", "concat('/c/', chunk_id, '.md') AS path", "CAST(NULL AS STRING) AS text_path", "'.md' AS ext", "1 AS start_line", "1 AS end_line")
    return lexical.fulltext(rows, "検索エンジン技術").drop("bm25")


_CJK_SQL = "c AS (SELECT chunk_id::BIGINT AS chunk_id, text, '/c/' || chunk_id || '.md' AS path, '/c/' || chunk_id || '.md' AS text_path, '.md' AS ext, 1 AS start_line, 1 AS end_line FROM (VALUES " + ", ".join(f"({i}, '{t}')" for i, t in _CJK_ROWS) + ") v(chunk_id, text))"


def _knn(limit=10, metric="cosine", prefix=None, extensions=None):
    def run(spark, sf_dir):
        places = chunks(spark, sf_dir).where(lexical.filters(prefix, extensions)).select("chunk_id", "path", "start_line", "end_line")
        held = corpus.vectors(spark, sf_dir)
        # The best rows first; only they are joined with their places.
        near = vector.nearest(held.join(places.select("chunk_id"), "chunk_id", "left_semi"), query_vector(spark, sf_dir), limit, metric)
        return near.join(places, "chunk_id").select("rank", "chunk_id", "path", "start_line", "end_line", (F.round("distance", 6) + 0.0).alias("distance"))

    return run


def _knn_sql(keep="TRUE", metric="cosine", limit=10):
    d = {"cosine": "1 - list_inner_product(e.v, q.v) / (sqrt(list_inner_product(e.v, e.v)) * sqrt(list_inner_product(q.v, q.v)))", "l2": "list_distance(e.v, q.v)"}[metric]
    return f"""WITH RECURSIVE {_FILES}, e AS (SELECT vec_id * 16777216 AS chunk_id, embedding::DOUBLE[] AS v FROM embeddings), q AS (SELECT v FROM e WHERE chunk_id = 0),
n AS (SELECT chunk_id, path, start_line, end_line, {d} AS distance FROM c JOIN e USING (chunk_id), q WHERE {keep} ORDER BY distance, chunk_id LIMIT {limit})
SELECT CAST(row_number() OVER (ORDER BY distance, chunk_id) AS INTEGER) AS rank, chunk_id, path, start_line, end_line, round(distance, 6) + 0.0::DOUBLE AS distance FROM n"""


def semantic_search(spark, sf_dir, limit=10):
    near = _knn(limit)(spark, sf_dir)
    return near.select("rank", "chunk_id", "path", "start_line", "end_line", F.round(vector.similarity(F.col("distance")), 6).alias("score"))


def hybrid(spark, sf_dir, query="erat", limit=10, semantic=True):
    n = fusion.pool(limit)
    lists = {"fts": lexical.search(corpus.index(spark, sf_dir), query, n).select("chunk_id", "rank")}
    if semantic:
        lists["vector"] = _knn(n)(spark, sf_dir).select("chunk_id", "rank")
    return lists, limit


def hybrid_search_rrf(spark, sf_dir):
    return fusion.rrf(*hybrid(spark, sf_dir))


def hybrid_lexical_only_degrade(spark, sf_dir):
    """Without an encoder the lexical list alone is fused."""
    return fusion.rrf(*hybrid(spark, sf_dir, semantic=False))


def hybrid_total_candidates(spark, sf_dir):
    lists, _ = hybrid(spark, sf_dir)
    return lists["fts"].select("chunk_id").union(lists["vector"].select("chunk_id")).agg(F.countDistinct("chunk_id").alias("total_candidates"))


def like_escape_literal(spark, sf_dir):
    return chunks(spark, sf_dir).where(lexical.like(F.col("text"), "%")).select("chunk_id")


_LISTS = f"f AS (SELECT chunk_id, rank FROM ({_bm25_sql(['erat'], 'TRUE', limit=25)})), v AS (SELECT chunk_id, rank FROM ({_knn_sql(limit=25)}))"
_SEMANTIC = f"SELECT rank, chunk_id, path, start_line, end_line, round(greatest(0, 1 - distance), 6) AS score FROM ({_knn_sql()})"


def _rrf_sql(parts: str, names: list[str]) -> str:
    cols = ", ".join(f"max(CASE WHEN l = '{n}' THEN rank END) AS {n}_rank" for n in names)
    return f"""WITH {_LISTS}, u AS ({parts}), g AS (SELECT chunk_id, sum(1::DOUBLE / (60 + rank)) AS raw, {cols} FROM u GROUP BY chunk_id ORDER BY raw DESC, chunk_id LIMIT 10)
SELECT CAST(row_number() OVER (ORDER BY raw DESC, chunk_id) AS INTEGER) AS rank, chunk_id, round(raw, 6) AS score, {', '.join(f'{n}_rank' for n in names)} FROM g"""


#: A stated set of queries that are answered together.
BATCH = ["erat", "erat tion", "ana", "the", "ent ent", "zzzznone", "zzzznone erat", "Tion  an", "re"]


def fulltext_batch(spark, sf_dir):
    asked = spark.createDataFrame(list(enumerate(BATCH)), "query_id int, query string")
    return lexical.fulltext_batch(corpus.index(spark, sf_dir), asked)


_OVER = "len(list_filter(range(1, length(lower(text)) - length(phrase) + 2), lambda i: substr(lower(text), i, length(phrase)) = phrase))"
_BATCH_SQL = f"""WITH RECURSIVE {_FILES},
q AS (SELECT query_id, lower(t) AS phrase, count(*) AS times FROM (SELECT query_id, unnest(regexp_split_to_array(query, '\\s+')) AS t FROM (VALUES {', '.join(f"({i}, '{x}')" for i, x in enumerate(BATCH))}) v(query_id, query)) WHERE length(t) >= 3 GROUP BY ALL),
h AS MATERIALIZED (SELECT phrase, chunk_id, path, start_line, end_line, greatest(length(text) - 2, 0) AS dl, {_OVER} AS f FROM c JOIN (SELECT DISTINCT phrase FROM q) ON contains(lower(text), phrase)),
s AS (SELECT count(*) AS n, avg(greatest(length(text) - 2, 0)) AS avgdl FROM c), d AS (SELECT phrase, count(*) AS df FROM h GROUP BY phrase),
m AS (SELECT query_id, count(*) AS needed FROM q GROUP BY query_id),
w AS (SELECT h.*, query_id, times, n, avgdl, ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) AS odds FROM h JOIN d USING (phrase) JOIN q USING (phrase), s),
g AS (SELECT query_id, chunk_id, path, start_line, end_line, sum(-(CASE WHEN odds <= 0 THEN 1e-6::DOUBLE ELSE odds END) * f * 2.2::DOUBLE / (f + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl)) * times) AS bm25 FROM w JOIN m USING (query_id) GROUP BY query_id, chunk_id, path, start_line, end_line HAVING count(*) = any_value(needed)),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY bm25, chunk_id) AS INTEGER) AS rank FROM g QUALIFY rank <= 10)
SELECT query_id, rank, chunk_id, path, start_line, end_line, round(CASE WHEN min(bm25) OVER w = max(bm25) OVER w THEN 1.0::DOUBLE ELSE (max(bm25) OVER w - bm25) / (max(bm25) OVER w - min(bm25) OVER w) END, 6) AS score FROM r WINDOW w AS (PARTITION BY query_id)"""

QUERIES = {
    "fulltext_batch": fulltext_batch,
    "fulltext_search": _fulltext("erat"),
    "fulltext_two_terms": _fulltext("erat tion"),
    "fulltext_path_prefix": _fulltext("erat", prefix="/docs/src1"),
    "fulltext_extensions": _fulltext("ent", extensions=["TXT", ".pdf"]),
    "fulltext_mixed_short": _fulltext("erat wh"),
    "fulltext_all_short": _fulltext("wh é"),
    "fulltext_relaxed_or": _fulltext("zzzznone erat"),
    "fulltext_relaxed_cjk": fulltext_relaxed_cjk,
    "fulltext_empty": _fulltext("zzzznone"),
    "fulltext_overlap": _fulltext("ana"),
    "like_escape_literal": like_escape_literal,
    "knn_cosine": _knn(),
    "knn_l2": _knn(metric="l2"),
    "knn_filtered_path": _knn(prefix="/docs/src1"),
    "knn_filtered_ext": _knn(extensions=["md"]),
    "semantic_search": semantic_search,
    "hybrid_search_rrf": hybrid_search_rrf,
    "hybrid_lexical_only_degrade": hybrid_lexical_only_degrade,
    "hybrid_total_candidates": hybrid_total_candidates,
}
_SHORT = lambda t: f"contains({_FOLD.format('text')}, '{t}')"
ORACLES = {
    "fulltext_batch": _BATCH_SQL,
    "fulltext_search": _bm25_sql(["erat"], "TRUE"),
    "fulltext_two_terms": _bm25_sql(["erat", "tion"], "TRUE"),
    "fulltext_path_prefix": _bm25_sql(["erat"], f"starts_with({_FOLD.format('path')}, '/docs/src1')"),
    "fulltext_extensions": _bm25_sql(["ent"], "ext IN ('.txt', '.pdf')"),
    "fulltext_mixed_short": _bm25_sql(["erat"], _SHORT("wh")),
    "fulltext_all_short": f"WITH RECURSIVE {_FILES}, b AS (SELECT * FROM c WHERE {_SHORT('wh')} AND {_SHORT('é')} ORDER BY chunk_id LIMIT 10) SELECT CAST(row_number() OVER (ORDER BY chunk_id) AS INTEGER) AS rank, chunk_id, path, text_path, ext, start_line, end_line, count(*) OVER () AS total_candidates, '{lexical.SHORT_NOTE}' AS note, 1.0::DOUBLE AS score FROM b",
    "fulltext_relaxed_or": _bm25_sql(["erat", "zzzznone"], "TRUE", every=False, note=lexical.RELAXED_NOTE),
    "fulltext_relaxed_cjk": _bm25_sql(sorted({"検索エ", "索エン", "エンジ", "ンジン", "ジン技", "ン技術"}), "TRUE", every=False, rows=_CJK_SQL),
    "fulltext_empty": _bm25_sql(["zzzznone"], "TRUE"),
    "fulltext_overlap": _bm25_sql(["ana"], "TRUE"),
    "like_escape_literal": f"WITH RECURSIVE {_FILES} SELECT chunk_id FROM c WHERE contains(text, '%')",
    "knn_cosine": _knn_sql(),
    "knn_l2": _knn_sql(metric="l2"),
    "knn_filtered_path": _knn_sql("starts_with(path, '/docs/src1')"),
    "knn_filtered_ext": _knn_sql("ext = '.md'"),
    "semantic_search": _SEMANTIC,
    "hybrid_search_rrf": _rrf_sql("SELECT chunk_id, rank, 'fts' AS l FROM f UNION ALL SELECT chunk_id, rank, 'vector' FROM v", ["fts", "vector"]),
    "hybrid_lexical_only_degrade": _rrf_sql("SELECT chunk_id, rank, 'fts' AS l FROM f", ["fts"]),
    "hybrid_total_candidates": f"WITH {_LISTS} SELECT count(DISTINCT chunk_id) AS total_candidates FROM (SELECT chunk_id FROM f UNION ALL SELECT chunk_id FROM v)",
}
