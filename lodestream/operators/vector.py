"""Vector distances as expressions and exact filtered top-k."""

from __future__ import annotations

from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.chunking import ORDINAL_BITS


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column) -> Column:
    """A vector of length one; a zero vector stays."""
    n = norm(a)
    return F.transform(a, lambda x: F.when(n > 0, x.cast("double") / n).otherwise(x.cast("double")))


def distance(a: Column, b: Column, metric: str = "cosine") -> Column:
    if metric == "cosine":
        return 1 - dot(a, b) / (norm(a) * norm(b))
    if metric == "l2":
        return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, v: s + v))
    raise ValueError(f"no such metric: {metric}")


def nearest(rows: DataFrame, query: list[float], limit: int, metric: str = "cosine", vector: str = "embedding", key: str = "chunk_id") -> DataFrame:
    """The nearest rows with `distance`, ties to the smaller key; filter rows before the call, and the result is exact."""
    q = F.array(*(F.lit(float(x)) for x in query))
    near = rows.withColumn("distance", distance(F.col(vector), q, metric)).orderBy("distance", key).limit(limit)
    return near.withColumn("rank", F.row_number().over(Window.orderBy("distance", key)))


def nearest_stored(index, query: list[float], limit: int, keep: Column | None = None) -> DataFrame:
    """The nearest chunks of an index that holds vectors of length one, by cosine distance, with their places: one product a row, no text is read or encoded."""
    size = sum(x * x for x in query) ** 0.5
    q = F.array(*(F.lit(float(x) / size if size else 0.0) for x in query))
    rows = index.snapshot.vectors(index.spark).where(F.size("embedding") == len(query))
    files = index.files.select("file_id", "path", "text_path", "ext")
    if keep is not None:
        own = files.where(keep).select("file_id")
        rows = rows.withColumn("file_id", F.shiftright("chunk_id", ORDINAL_BITS)).join(own, "file_id", "left_semi")
    best = rows.select("chunk_id", (1 - dot(F.col("embedding"), q)).alias("distance")).orderBy("distance", "chunk_id").limit(limit).collect()
    ids = [r.chunk_id for r in best]
    near = index.spark.createDataFrame([(i, *r) for i, r in enumerate(best, 1)], "rank int, chunk_id long, distance double")
    places = index.bare.where(F.col("chunk_id").isin(*ids)).select("chunk_id", "file_id", "start_line", "end_line")
    return F.broadcast(near).join(places, "chunk_id").join(files.where(F.col("file_id").isin(*{i >> ORDINAL_BITS for i in ids})), "file_id")


#: Queries that meet the vectors in one pass, whose vectors every task holds.
PASS = 1024


def nearest_batch(vectors: DataFrame, queries: DataFrame, limit: int) -> DataFrame:
    """query_id, rank, chunk_id and score (cosine, to six places, at least 0) of the nearest rows for many queries (query_id, embedding) at once.

    Vectors are of length one or empty. A pass takes PASS queries, which it gives to every task; a
    block of rows is one matrix product, of which each query's best go on to the merge.
    """
    asked = queries.where(F.size("embedding") > 0).select("query_id", "embedding")

    def one(part: list) -> DataFrame:
        ids = np.array([r.query_id for r in part])
        q = np.array([r.embedding for r in part], float)
        q /= np.sqrt((q * q).sum(axis=1, keepdims=True))

        def run(batches):
            for batch in batches:
                rows = batch.column(0).to_numpy()
                sizes = np.diff(batch.column(1).offsets.to_numpy())
                full = np.flatnonzero(sizes == q.shape[1])
                flat = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(float)
                if not len(full):
                    continue
                v = flat[np.repeat(sizes == q.shape[1], sizes)].reshape(len(full), -1)
                score = np.round(np.maximum(q @ v.T, 0), 6)
                order = np.lexsort((np.broadcast_to(rows[full], score.shape), -score))[:, :limit]
                found = np.repeat(ids, order.shape[1]), rows[full][order].ravel(), np.take_along_axis(score, order, 1).ravel()
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], ["query_id", "chunk_id", "score"])

        found = vectors.select("chunk_id", "embedding").mapInArrow(run, "query_id long, chunk_id long, score double")
        w = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
        return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit).select("query_id", "rank", "chunk_id", "score")

    out, every = None, asked.toLocalIterator()
    for part in iter(lambda: list(islice(every, PASS)), []):
        out = one(part) if out is None else out.unionByName(one(part))
    return out if out is not None else vectors.sparkSession.createDataFrame([], "query_id long, rank int, chunk_id long, score double")


def similarity(d: Column) -> Column:
    return F.greatest(F.lit(0.0), 1 - d)
