"""Chunking, incremental indexing, roots and settings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..functions.chunking import CHUNKS_SQL, chunks_of
from ..sources import corpus


def chunk_documents(spark, sf_dir) -> DataFrame:
    """The chunks of every document."""
    own = chunks_of(corpus.table(spark, sf_dir, "documents"), "doc_id")
    return own.select("chunk_id", "doc_id", "ordinal", "start_line", "end_line", F.length("text").alias("n_chars"), F.sha2("text", 256).alias("text_sha256"))


def chunk_line_coverage(spark, sf_dir):
    return chunk_documents(spark, sf_dir).groupBy("doc_id").agg(F.min("start_line").alias("first_line"), F.max("end_line").alias("last_line"))


def chunk_ordinal_density(spark, sf_dir):
    c = chunk_documents(spark, sf_dir).groupBy("doc_id").agg(F.count("*").alias("n"), F.max("ordinal").alias("top"), F.min("start_line").alias("low"))
    return c.select("doc_id", ((F.col("top") == F.col("n") - 1) & (F.col("low") >= 1)).alias("dense"))


def _lines(spark, sf_dir):
    return corpus.table(spark, sf_dir, "documents").select("doc_id", F.posexplode(text.lines(F.col("text"))).alias("pos", "line"))


def nonblank_line_stats(spark, sf_dir):
    own = _lines(spark, sf_dir).where(F.col("line").rlike("(?U)\\S"))
    return own.groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"))


def oversize_line_pieces(spark, sf_dir):
    long = _lines(spark, sf_dir).where(F.length("line") > 2000)
    return long.select("doc_id", (F.col("pos") + 1).alias("line_no"), F.ceil(F.length("line") / 2000).alias("pieces"))


def snapshots(spark, sf_dir):
    """The current files and a previous state that differs by classes of the id."""
    now = corpus.files(spark, sf_dir).select("file_id", "source", "path", "size", (F.col("file_id") * 1000).alias("mtime"), F.sha2("text", 256).alias("hash"))
    k = F.col("file_id") % 10
    before = now.where(k != 0).select(
        "file_id", F.when(k == 1, "failed").otherwise("indexed").alias("status"), F.when(k == 3, F.col("size") + 1).otherwise(F.col("size")).alias("old_size"),
        F.when(k.isin(2, 3), F.col("mtime") - 1).otherwise(F.col("mtime")).alias("old_mtime"), F.when(k == 3, F.lit("-")).otherwise(F.col("hash")).alias("old_hash"),
    )
    return now, before


def index_prune_missing(spark, sf_dir):
    """Earlier files of a fully scanned root that the scan has not seen."""
    now, before = snapshots(spark, sf_dir)
    seen = now.where("file_id % 17 <> 5")
    return before.join(seen, "file_id", "left_anti").select("file_id")


def index_upsert_snapshot(spark, sf_dir):
    now, before = snapshots(spark, sf_dir)
    old = before.select("file_id", F.col("old_hash").alias("hash"), F.lit(0).alias("version"))
    new = now.where("file_id % 3 = 0").select("file_id", "hash", F.lit(1).alias("version"))
    return old.unionByName(new).groupBy("file_id").agg(F.max_by("hash", "version").alias("hash"), F.max("version").alias("version"))


def content_hash_dedup(spark, sf_dir):
    h = corpus.files(spark, sf_dir).select("file_id", F.sha2("text", 256).alias("hash"))
    return h.groupBy("hash").agg(F.count("*").alias("copies"), F.min("file_id").alias("first_id")).where("copies > 1")


def sidecar_orphans(spark, sf_dir):
    """Extracted texts that no current file refers to: all of last time's without this time's."""
    f = corpus.files(spark, sf_dir).where("text_path IS NOT NULL")
    keep = f.where("file_id % 4 <> 0").select("text_path")
    return f.select("text_path").distinct().join(keep, "text_path", "left_anti")


def _status(spark, sf_dir):
    k = F.col("file_id") % 20
    return corpus.files(spark, sf_dir).select("file_id", "source", F.when(k == 3, "failed").when(k == 4, "skipped").otherwise("indexed").alias("status"))


def root_status_counts(spark, sf_dir):
    n = lambda s: F.count_if(F.col("status") == s)
    return _status(spark, sf_dir).groupBy("source").agg(n("indexed").alias("indexed"), n("failed").alias("failed"), n("skipped").alias("skipped"))


def root_overview(spark, sf_dir):
    per = root_status_counts(spark, sf_dir)
    total = _status(spark, sf_dir).agg(F.count("*").alias("total_files"))
    # Every root there is, and one that has no file yet.
    roots = corpus.table(spark, sf_dir, "documents").select("source").distinct().unionByName(spark.createDataFrame([("none yet",)], "source string"))
    rows = roots.join(per, "source", "left").crossJoin(F.broadcast(total))
    return rows.select("source", F.coalesce("indexed", F.lit(0)).alias("indexed"), "total_files")


def root_strict_lookup(spark, sf_dir):
    asked = spark.createDataFrame([("src1",), ("src3",), ("nowhere",)], "source string")
    roots = corpus.files(spark, sf_dir).select("source").distinct().withColumn("known", F.lit(True))
    return asked.join(roots, "source", "left").select("source", F.coalesce("known", F.lit(False)).alias("known"))


def corpus_counts(spark, sf_dir):
    d, e = (corpus.table(spark, sf_dir, t).agg(F.count("*").alias(n)) for t, n in (("documents", "files"), ("embeddings", "vectors")))
    return d.crossJoin(e)


def bounded_count(spark, sf_dir):
    return corpus.table(spark, sf_dir, "documents").select("doc_id").limit(50).agg(F.count("*").alias("n"))


_NOW = "now AS (SELECT doc_id AS file_id, n_chars AS size, doc_id * 1000 AS mtime, sha256(text) AS hash FROM documents)"
_BEFORE = "bef AS (SELECT file_id, CASE WHEN file_id % 10 = 1 THEN 'failed' ELSE 'indexed' END AS status, CASE WHEN file_id % 10 = 3 THEN '-' ELSE hash END AS old_hash FROM now WHERE file_id % 10 <> 0)"
_ST = "s AS (SELECT doc_id AS file_id, source, CASE doc_id % 20 WHEN 3 THEN 'failed' WHEN 4 THEN 'skipped' ELSE 'indexed' END AS status FROM documents)"
_LINES = "l AS (SELECT doc_id, unnest(string_split(CASE WHEN ends_with(text, chr(10)) THEN text[:-2] ELSE text END, chr(10))) AS line, generate_subscripts(string_split(CASE WHEN ends_with(text, chr(10)) THEN text[:-2] ELSE text END, chr(10)), 1) - 1 AS pos FROM documents WHERE text <> '')"
_STATS = f"WITH {_LINES}, g AS (SELECT doc_id, count(*) AS n_lines, min(pos) AS first_pos, max(pos) AS last_pos FROM l WHERE regexp_matches(line, '\\S') GROUP BY doc_id)"

QUERIES = {f.__name__: f for f in (chunk_documents, chunk_line_coverage, chunk_ordinal_density, nonblank_line_stats, oversize_line_pieces, index_prune_missing, index_upsert_snapshot, content_hash_dedup, sidecar_orphans, root_status_counts, root_overview, root_strict_lookup, corpus_counts, bounded_count)}
ORACLES = {
    "chunk_documents": f"WITH RECURSIVE {CHUNKS_SQL} SELECT chunk_id, file_id AS doc_id, ordinal, start_line, end_line, CAST(length(text) AS INTEGER) AS n_chars, sha256(text) AS text_sha256 FROM chunks",
    "chunk_line_coverage": _STATS + " SELECT doc_id, CAST(first_pos + 1 AS INTEGER) AS first_line, CAST(last_pos + 1 AS INTEGER) AS last_line FROM g",
    "chunk_ordinal_density": _STATS + " SELECT doc_id, TRUE AS dense FROM g",
    "nonblank_line_stats": _STATS + " SELECT doc_id, n_lines, CAST(first_pos AS INTEGER) AS first_pos, CAST(last_pos AS INTEGER) AS last_pos FROM g",
    "oversize_line_pieces": f"WITH {_LINES} SELECT doc_id, CAST(pos + 1 AS INTEGER) AS line_no, CAST(ceil(length(line) / 2000.0) AS BIGINT) AS pieces FROM l WHERE length(line) > 2000",
    "index_prune_missing": "SELECT doc_id AS file_id FROM documents WHERE doc_id % 10 <> 0 AND doc_id % 17 = 5",
    "index_upsert_snapshot": f"WITH {_NOW}, {_BEFORE} SELECT file_id, CASE WHEN file_id % 3 = 0 THEN hash ELSE old_hash END AS hash, CASE WHEN file_id % 3 = 0 THEN 1 ELSE 0 END AS version FROM now LEFT JOIN bef USING (file_id) WHERE bef.file_id IS NOT NULL OR file_id % 3 = 0",
    "content_hash_dedup": "SELECT sha256(text) AS hash, count(*) AS copies, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1",
    "sidecar_orphans": "WITH f AS (SELECT doc_id, substr(sha256(text), 1, 2) || '/' || sha256(text) || '.txt' AS text_path FROM documents WHERE lang NOT IN ('en', 'fr')) SELECT DISTINCT text_path FROM f WHERE text_path NOT IN (SELECT text_path FROM f WHERE doc_id % 4 <> 0)",
    "root_status_counts": f"WITH {_ST} SELECT source, count(*) FILTER (status = 'indexed') AS indexed, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'skipped') AS skipped FROM s GROUP BY source",
    "root_overview": f"WITH {_ST}, r AS (SELECT DISTINCT source FROM documents UNION ALL SELECT 'none yet') SELECT r.source, count(s.file_id) FILTER (status = 'indexed') AS indexed, (SELECT count(*) FROM s) AS total_files FROM r LEFT JOIN s USING (source) GROUP BY r.source",
    "root_strict_lookup": "SELECT q AS source, q IN (SELECT source FROM documents) AS known FROM (VALUES ('src1'), ('src3'), ('nowhere')) v(q)",
    "corpus_counts": "SELECT (SELECT count(*) FROM documents) AS files, (SELECT count(*) FROM embeddings) AS vectors",
    "bounded_count": "SELECT count(*) AS n FROM (SELECT doc_id FROM documents LIMIT 50)",
}
