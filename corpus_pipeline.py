"""Documents to packed training windows: toxicity, near-duplicates, personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns a frame, which is written as Parquet and read
again as the next stage's docs. All but the last return the columns of documents. Defined results:
null and empty texts pass the first three stages as they are and pack to the end id alone; rows that
repeat an id count as copies of one document, of which the row with the smallest hash stays; rows
without an id all stay; of a group of near copies the smallest id stays; very long texts are taken
whole; an empty table stays empty; further columns of documents are carried along, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestream.llm import common, minhash, packing, pii, toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below one half; the model learns from labels that aren't held out."""
    return toxicity.keep_clean(docs, common.table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest document of each group that shares four fifths of its five-word shingles."""
    return minhash.keep_one(docs)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind."""
    return pii.redact(docs)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of windows of 2048 tokens."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("pii", redact_personal_data),
    ("packing", pack_windows),
]

#: Boosted trees, segment scores and subword merges can't be told in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, space = common.table(spark, sf_dir, "documents"), common.Space(spark)
    for name, stage in STAGES:
        done = space.keep(stage(spark, docs, sf_dir), f"pipeline-{name}")
        # What the stage read is no longer needed.
        space.drop_all_but(done)
        docs = done
    return docs


QUERIES = {"pipeline": run}
