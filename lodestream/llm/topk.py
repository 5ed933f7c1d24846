"""Exact top-k search by inner product: term-at-a-time accumulation in blocks.

Vectors are quantised and dealt into blocks of bounded size. A block of queries meets a block of
candidates in one task: for each term (component) the queries that hold it scatter its weight times
the block's postings into a dense array of scores. Partition selection keeps each query's best of
the block, with ties to the smaller id, and a ranked merge over blocks gives the whole result.
All pairs of a stated query set and the table are scored; no index is approximated.

Defined results: vectors that are null, or hold null or non-finite components (also once scaled),
take no part; rows with a null id neither; every other row is a candidate of its own and, where it
is asked for, a query of its own, also if ids repeat; vectors of another dimension than the query's
are compared over the components both have (an empty one scores 0); ties go to the smaller id; scores
are exact integers of any size, and one that no 64-bit integer holds is ranked exactly and returned
as null; with fewer than k candidates all are returned; an empty table gives no rows; very long
vectors make blocks of fewer rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Rows of a block of queries and of candidates, and bytes of a block's vectors.
QUERIES, CANDIDATES, BLOCK_BYTES = 1024, 8192, 8_000_000


def quantise(df: DataFrame, scale: int = 64, id_col: str = "vec_id", vector_col: str = "embedding", extra: tuple[str, ...] = ()) -> DataFrame:
    """id and v, the components' integers as doubles (which hold them exactly), and `extra` columns."""
    # A double above 2**63 is whole, and floor would cut it to a long.
    floor = lambda y: F.when(F.abs(y) < float(1 << 62), F.floor(y).cast("double")).otherwise(y)
    scaled = F.transform(vector_col, lambda v: v.cast("double") * scale)
    real = F.col(vector_col).isNotNull() & F.forall(scaled, lambda y: y.isNotNull() & ~F.isnan(y) & (F.abs(y) < float("inf")))
    return df.where(F.col(id_col).isNotNull() & real).select(F.col(id_col).cast("long").alias("id"), F.transform(scaled, floor).alias("v"), *extra)


def blocks(df: DataFrame, size: int, rows: int, name: str) -> DataFrame:
    """Rows dealt by a hash of their numbers into blocks of about `size`; a block is its rows' numbers, ids and vectors."""
    count = max(1, -(-rows // size))
    dealt = df.withColumn(name, F.pmod(F.xxhash64("row"), F.lit(count)).cast("int"))
    return dealt.groupBy(name).agg(*(F.collect_list(c).alias(f"{name}_{c}") for c in ("row", "id", "v")))


def _matrix(rows: pa.Array, ids: pa.Array, vectors: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row numbers, ids and vectors by component (terms first), by ascending id."""
    names, rows = (x.to_numpy(zero_copy_only=False) for x in (ids, rows))
    size = np.diff(vectors.offsets.to_numpy())
    width = int(size.max(initial=0))
    out = np.zeros((len(names), width))
    if width:
        out[np.arange(width) < size[:, None]] = vectors.flatten().to_numpy(zero_copy_only=False)
    order = np.lexsort((rows, names))
    return rows[order], names[order], np.ascontiguousarray(out[order].T)


def accumulate(queries: np.ndarray, postings: np.ndarray) -> np.ndarray:
    """Exact scores (queries x candidates) from whole weights by term; only a term's non-zero weights are touched.

    The smallest integers that hold any sum are used: 32 bits, 64 bits, or Python's own.
    """
    most = float(np.abs(queries).max(initial=0)) * float(np.abs(postings).max(initial=0)) * max(1, len(queries))
    kind = np.int32 if most < 1 << 30 else np.int64 if most < 1 << 62 else object
    if kind is object:
        whole = np.frompyfunc(int, 1, 1)
        queries, postings = whole(queries), whole(postings)
    else:
        queries, postings = queries.astype(kind), postings.astype(kind)
    scores = np.zeros((queries.shape[1], postings.shape[1]), kind)
    part = np.empty_like(scores)
    for q, p in zip(queries, postings, strict=False):
        rows, at = np.flatnonzero(q), np.flatnonzero(p)
        if kind is not object and 2 * len(at) > len(p) and 2 * len(rows) > len(q):
            np.multiply.outer(q, p, out=part)
            scores += part
        elif len(at) and len(rows):
            scores[np.ix_(rows, at)] += np.multiply.outer(q[rows], p[at])
    return scores


def best(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and places of each row's k best scores, earlier places first on ties."""
    n = scores.shape[1]
    if k >= n:
        return np.divmod(np.arange(scores.size), max(n, 1))
    down = -scores
    least = -(np.sort(down, axis=1) if scores.dtype == object else np.partition(down, k - 1, axis=1))[:, k - 1 : k]
    above, level = scores > least, scores == least
    take = above | (level & (np.cumsum(level, axis=1) <= k - above.sum(axis=1, keepdims=True)))
    return np.nonzero(take.astype(bool))


def top_k(vectors: DataFrame, asked: str, k: int = 20) -> DataFrame:
    """query_id, rank, vec_id, score for a frame of id and v (array of whole doubles); `asked` is the condition on rows that are queries."""
    vectors = common.materialise(vectors.select("id", "v").withColumn("row", F.monotonically_increasing_id()), "vectors")
    queries = vectors.where(asked)
    size = vectors.agg(F.count("*").alias("n"), F.count_if(F.expr(asked)).alias("q"), F.max(F.size("v")).alias("width")).first()
    fit = max(1, BLOCK_BYTES // (8 * max(size.width or 0, 1)))
    theirs = blocks(queries, min(QUERIES, fit), size.q, "q")
    groups = max(1, -(-size.n // min(CANDIDATES, fit)))
    ours = blocks(vectors, min(CANDIDATES, fit), size.n, "c")
    # Always a shuffle: the planner sees compressed files or shuffles, small beside the blocks, which a broadcast would gather on the driver.
    met = theirs.withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).join(ours.hint("merge"), "c")

    def run(batches):
        for batch in common.small_batches(batches, 1):
            column = lambda x: batch.column(batch.schema.get_field_index(x)).flatten()  # noqa: B023, E731
            q_rows, q_ids, q = _matrix(*(column(f"q_{x}") for x in ("row", "id", "v")))
            c_rows, c_ids, c = _matrix(*(column(f"c_{x}") for x in ("row", "id", "v")))
            for a in range(0, len(q_ids), 128):
                # One more than asked for, as a query may find itself.
                scores = accumulate(q[:, a : a + 128], c)
                row, col = best(scores, k + 1)
                other = c_rows[col] != q_rows[a + row]
                row, col = row[other], col[other]
                found = [int(x) for x in scores[row, col]]
                exact = pa.array(found, pa.int64()) if scores.dtype != object else pa.array([x if -(1 << 63) <= x < 1 << 63 else None for x in found], pa.int64())
                # Larger scores are ranked by text of equal width.
                wide = pa.array([None if -(1 << 63) <= x < 1 << 63 else f"{'1' if x > 0 else '0'}{abs(x) if x > 0 else 10**WIDE - 1 + x:0{WIDE}d}" for x in found], pa.string()) if scores.dtype == object else pa.nulls(len(found), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(q_rows[a + row]), pa.array(q_ids[a + row]), pa.array(c_ids[col]), exact, wide], ["row", "query_id", "vec_id", "score", "wide"])

    every = common.map_arrow(met, run, "row long, query_id long, vec_id long, score long, wide string")
    # Scores beyond 64 bits stand before (or behind) all that fit.
    sign = F.when(F.col("wide").isNull(), 0).when(F.col("wide").startswith("1"), 1).otherwise(-1)
    order = Window.partitionBy("row").orderBy(sign.desc(), F.desc("wide"), F.desc("score"), "vec_id")
    ranked = every.withColumn("rank", F.row_number().over(order))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


#: Digits of the largest sum of products of doubles.
WIDE = 640


def op7_topk(spark, sf_dir: str) -> DataFrame:
    return top_k(quantise(common.table(spark, sf_dir, "embeddings")), "id % 20 = 0")


OP7_SQL = """
WITH v AS MATERIALIZED (
  SELECT vec_id, row_number() OVER () AS r, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.r AS own, q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score FROM v q JOIN v c ON q.r <> c.r WHERE q.vec_id % 20 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY own ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
