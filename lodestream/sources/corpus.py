"""The driver's tables as the engine's views: files, chunks, vectors, sessions, failures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TEXT, OFFICE = (".md", ".txt"), (".pdf", ".docx")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One file per document; office formats have a text path derived from a hash of the text."""
    lang = F.col("lang")
    ext = F.when(lang == "en", ".md").when(lang == "fr", ".txt").when(lang == "de", ".pdf").otherwise(".docx")
    digest = F.sha2("text", 256)
    sidecar = F.concat_ws("/", F.substring(digest, 1, 2), F.concat(digest, F.lit(".txt")))
    d = table(spark, sf_dir, "documents").withColumn("ext", ext)
    return d.select(
        F.col("doc_id").alias("file_id"), "source", F.concat(F.lit("/docs/"), "source", F.lit("/"), F.col("doc_id").cast("string"), "ext").alias("path"),
        "ext", F.col("n_chars").alias("size"), F.when(F.col("ext").isin(*OFFICE), sidecar).alias("text_path"), "text",
    )


def index(spark: SparkSession, sf_dir: str, encode=None):
    """The index of the documents' chunks, built once a session: of postings, or of vectors where `encode` gives them."""
    from .store import index_of

    return index_of(spark, f"{sf_dir}/documents.parquet", files(spark, sf_dir), encode)


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents' chunks with their files' paths, made as they are read: what looks up no gram needs no index."""
    from ..functions.chunking import chunks_of

    own = files(spark, sf_dir)
    return chunks_of(own.select("file_id", "text")).join(own.select("file_id", "path", "text_path", "ext"), "file_id")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A vector for the first chunk of each file."""
    from ..functions.chunking import ORDINAL_BITS

    return table(spark, sf_dir, "embeddings").select(F.shiftleft(F.col("vec_id").cast("long"), ORDINAL_BITS).alias("chunk_id"), "embedding")


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns as session lines with a synthetic clock."""
    c = table(spark, sf_dir, "conversations")
    return c.select(F.col("conv_id").alias("file"), (F.lit(1704067200) + F.col("conv_id") * 3600 + F.col("turn") * 60).alias("ts"), F.concat(F.lit("p"), (F.col("conv_id") % 7).cast("string")).alias("project"), F.col("role").alias("type"), "text")


def failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_failures(table(spark, sf_dir, "events"))


def as_failures(events: DataFrame) -> DataFrame:
    """Failure records of an event table or stream."""
    e = events.where("event_type = 'error'")
    return e.select("event_id", F.concat(F.lit("tool"), (F.col("user_id") % 7).cast("string")).alias("tool_name"), F.concat(F.lit("e"), (F.floor(F.col("value")) % 5).cast("string")).alias("pattern"), F.date_format("ts", "yyyyMMdd").alias("dt"))
