"""Reciprocal rank fusion of ranked lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

RRF_K = 60


def pool(limit: int) -> int:
    return max(2 * limit, 25)


def rrf(lists: dict[str, DataFrame], limit: int, k: int = RRF_K) -> DataFrame:
    """lists: frames of chunk_id and rank by name; gives rank, chunk_id, score and each list's rank or null."""
    names = list(lists)
    parts = [d.select("chunk_id", F.lit(n).alias("list"), "rank") for n, d in lists.items()]
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    fused = both.groupBy("chunk_id").agg(F.sum(1 / (k + F.col("rank"))).alias("raw"), *(F.max(F.when(F.col("list") == n, F.col("rank"))).alias(f"{n}_rank") for n in names))
    top = fused.orderBy(F.desc("raw"), "chunk_id").limit(limit)
    ranked = top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("raw"), "chunk_id")))
    return ranked.select("rank", "chunk_id", F.round("raw", 6).alias("score"), *(f"{n}_rank" for n in names))
