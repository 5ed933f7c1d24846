"""Hard-negative mining by bit-sliced integer products.

Vectors are whole numbers in two's complement, dealt into blocks of bounded size. A block of anchors
meets a block of rows in one task, which goes through the rows' components bit plane by bit plane, the
most significant first: the product of an anchor with a plane, weighted by its power of two, is added
to the scores, and what the planes to come can add or take bounds every score from both sides. Pairs
whose interval can't qualify any more are dropped after each plane, rows that no anchor of the group
waits for leave the planes. The pairs left at the last plane have exact scores; nothing is approximate.

A first pass finds each anchor's positives (best rows of the same label), a second one the negatives
in the window of scores that each positive opens. A pair is dropped from the first when enough rows
of the block surely score more, from the second when its interval leaves all the anchor's windows or
enough rows surely in the window score more. Blocks' finds are ranked and merged.

Defined results: rows with a null id or label, a null vector, or null or non-finite components (also
once scaled) take no part; rows that repeat an id are rows of their own; vectors of another length are
compared over the components both have; ties go to the smaller id, then to the row read first; scores
are exact integers of any size, and one that no 64-bit integer holds is ranked exactly and returned as
null; an anchor without positives, or with none in the window, has no rows; an empty table gives none;
other columns are ignored.
"""

from __future__ import annotations

from fractions import Fraction
from math import ceil, floor

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common, topk

#: Rows of a block of anchors and of rows, bytes of a block's vectors, anchors that share their dropped rows.
ANCHORS, ROWS, BLOCK_BYTES, GROUP = 256, 8192, 4_000_000, 32
#: Digits of the largest sum of products of doubles.
WIDE = 640


class Planes:
    """Bit planes of whole components (terms first), most significant first."""

    def __init__(self, anchors: np.ndarray, rows: np.ndarray):
        self.bits = max((int(x).bit_length() for x in (rows.max(initial=0), rows.min(initial=0))), default=0) + 1
        # Sums below 2**53 are exact as doubles; Python's integers hold the rest.
        self.kind = np.float64 if self.bits <= 53 and float(np.abs(anchors).sum(axis=0).max(initial=0)) < 2.0 ** (53 - self.bits) else object
        if self.kind is object:
            whole = np.frompyfunc(int, 1, 1)
            self.anchors, self.rows = whole(anchors), whole(rows)
        else:
            self.anchors, self.rows = anchors, rows.astype(np.int64)
        self.low, self.high = np.minimum(self.anchors, 0).sum(axis=0), np.maximum(self.anchors, 0).sum(axis=0)

    def plane(self, bit: int, cols: np.ndarray) -> np.ndarray:
        return ((self.rows[:, cols] >> bit) & 1).astype(self.kind)

    def whole(self, x) -> np.ndarray:
        return np.zeros(x, self.kind)


def sliced(anchors: np.ndarray, rows: np.ndarray, may: np.ndarray, still):
    """Anchor, row and exact score of the pairs that `still` leaves; `may` marks the pairs to begin with.

    still(anchor, low, high) gets the bounds of an anchor's open pairs and says which stay open.
    """
    planes = Planes(anchors, rows)
    for a in range(0, may.shape[0], GROUP):
        open_ = may[a : a + GROUP]
        cols = np.flatnonzero(open_.any(axis=0))
        open_ = open_[:, cols]
        q = planes.anchors[:, a : a + GROUP].T
        scores = planes.whole(open_.shape)
        for bit in range(planes.bits - 1, -1, -1):
            if not len(cols):
                break
            weight = -(1 << bit) if bit == planes.bits - 1 else 1 << bit
            scores += q @ planes.plane(bit, cols) * weight
            rest = (1 << bit) - 1
            for i in range(len(open_)):
                at = np.flatnonzero(open_[i])
                if len(at):
                    s = scores[i, at]
                    open_[i, at] = still(a + i, s + rest * planes.low[a + i], s + rest * planes.high[a + i])
            wanted = open_.any(axis=0)
            if 2 * wanted.sum() < len(cols):
                cols, open_, scores = cols[wanted], open_[:, wanted], scores[:, wanted]
        i, j = np.nonzero(open_)
        yield a + i, cols[j], scores[i, j]


def _kth(values: np.ndarray, k: int):
    """The k-th largest value, or none if there are fewer."""
    if len(values) < k:
        return None
    return np.sort(values)[-k] if values.dtype == object else np.partition(values, len(values) - k)[-k]


def can_lead(k: int):
    """Pairs that can still be among an anchor's k best."""

    def still(_, low, high):
        least = _kth(low, k)
        return np.ones(len(low), bool) if least is None else high >= least

    return still


def can_fit(windows: list[list[tuple[int, int]]], k: int):
    """Pairs that can still be among the k best of one of the anchor's windows."""

    def still(anchor, low, high):
        out = np.zeros(len(low), bool)
        for least, most in windows[anchor]:
            inside = (high >= least) & (low <= most)
            sure = _kth(low[(low >= least) & (high <= most)], k)
            out |= inside if sure is None else inside & (high >= sure)
        return out

    return still


def _window(score: int, low: Fraction, high: Fraction) -> tuple[int, int]:
    """Whole scores s with low * score <= s <= high * score; none if the first is above the second."""
    return ceil(low * score), floor(high * score)


def _scores(found: list[int]) -> tuple[pa.Array, pa.Array]:
    """Scores that 64 bits hold, and a text that ranks those beyond them."""
    fits = [-(1 << 63) <= x < 1 << 63 for x in found]
    wide = [None if ok else f"{'1' if x > 0 else '0'}{x if x > 0 else 10**WIDE - 1 + x:0{WIDE}d}" for x, ok in zip(found, fits, strict=True)]
    return pa.array([x if ok else None for x, ok in zip(found, fits, strict=True)], pa.int64()), pa.array(wide, pa.string())


def _ranked(*key: str):
    """Larger scores first, those beyond 64 bits before or behind all that fit; then smaller ids, then rows read first."""
    beyond = F.when(F.col("wide").isNull(), 0).when(F.col("wide").startswith("1"), 1).otherwise(-1)
    return Window.partitionBy(*key).orderBy(beyond.desc(), F.desc("wide"), F.desc("score"), "id", "row")


def _blocks(df: DataFrame, size: int, count: int, name: str, extra: tuple[str, ...]) -> DataFrame:
    """Rows dealt by a hash of their numbers into `count` blocks of about `size` rows."""
    dealt = df.withColumn(name, F.pmod(F.xxhash64("row"), F.lit(max(1, -(-count // size)))).cast("int"))
    return dealt.groupBy(name).agg(*(F.collect_list(c).alias(f"{name}_{c}") for c in ("row", "id", "label", "v", *extra)))


def _side(batch: pa.RecordBatch, name: str, extra: tuple[str, ...] = ()):
    """Row numbers, ids, labels, vectors (terms first) and extra columns of a block, by ascending id."""
    column = lambda x: batch.column(batch.schema.get_field_index(f"{name}_{x}")).flatten()
    rows, ids, v = topk._matrix(column("row"), column("id"), column("v"))
    order = np.lexsort((column("row").to_numpy(), column("id").to_numpy()))
    return rows, ids, column("label").to_numpy()[order], v, *(column(x).take(pa.array(order)) for x in extra)


def _same_width(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = min(len(a), len(b))
    return a[:n], b[:n]


def mine(rows: DataFrame, asked: Column, positives: int = 5, keep: int = 10, low: Fraction = Fraction(3, 10), high: Fraction = Fraction(9, 10)) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for a frame of id, label and v (array of whole doubles).

    An anchor's positives are its `positives` best other rows of the same label; the negatives of each
    are the `keep` best rows of other labels whose score is `low` to `high` times the positive's.
    """
    space = common.Space(rows.sparkSession)
    taken = rows.where(F.col("id").isNotNull() & F.col("label").isNotNull()).select("id", F.col("label").cast("long").alias("label"), "v", asked.alias("asked"))
    table = space.keep(taken.withColumn("row", F.monotonically_increasing_id()), "vectors")
    size = table.agg(F.count("*").alias("n"), F.count_if("asked").alias("q"), F.max(F.size("v")).alias("width")).first()
    fit = max(1, BLOCK_BYTES // (8 * max(size.width or 0, 1)))
    groups = max(1, -(-size.n // min(ROWS, fit)))
    ours = _blocks(table, min(ROWS, fit), size.n, "c", ())

    def met(anchors: DataFrame, *extra: str) -> DataFrame:
        blocks = _blocks(anchors, min(ANCHORS, fit), size.q, "q", extra)
        # Always a shuffle: the planner sees compressed files or shuffles, small beside the blocks, which a broadcast would gather on the driver.
        return blocks.withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).join(ours.hint("merge"), "c")

    def leaders(batches):
        for batch in common.small_batches(batches, 1):
            q_rows, q_ids, q_labels, q = _side(batch, "q")
            c_rows, c_ids, c_labels, c = _side(batch, "c")
            # Anchors of a label together, so that other labels' rows leave the planes at once.
            order = np.argsort(q_labels, kind="stable")
            q_rows, q_labels, q = q_rows[order], q_labels[order], q[:, order]
            may = (q_labels[:, None] == c_labels) & (q_rows[:, None] != c_rows)
            for i, j, s in sliced(*_same_width(q, c), may, can_lead(positives)):
                score, wide = _scores([int(x) for x in s])
                exact = pa.array([str(int(x)) for x in s], pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(q_rows[i]), pa.array(c_rows[j]), pa.array(c_ids[j]), score, wide, exact], ["anchor", "row", "id", "score", "wide", "exact"])

    first = common.map_arrow(met(table.where("asked")), leaders, "anchor long, row long, id long, score long, wide string, exact string")
    best = first.withColumn("rank", F.row_number().over(_ranked("anchor"))).where(F.col("rank") <= positives)
    told = space.keep(best.select("anchor", "rank", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"), "exact"), "positives")
    per_anchor = told.groupBy(F.col("anchor").alias("row")).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "exact"))), lambda x: x["exact"]).alias("exact"))
    anchors = table.where("asked").join(per_anchor.hint("merge"), "row")

    def fitting(batches):
        for batch in common.small_batches(batches, 1):
            q_rows, q_ids, q_labels, q, exact = _side(batch, "q", ("exact",))
            c_rows, c_ids, c_labels, c = _side(batch, "c")
            windows = [[_window(int(x), low, high) for x in of] for of in exact.to_pylist()]
            for i, j, s in sliced(*_same_width(q, c), q_labels[:, None] != c_labels, can_fit(windows, keep)):
                scores = [int(x) for x in s]
                # A pair is told for each window that it lies in.
                hits = [(p, n + 1) for p, x in enumerate(scores) for n, (least, most) in enumerate(windows[i[p]]) if least <= x <= most]
                at, rank = (np.array(x, np.int64) for x in (zip(*hits, strict=True) if hits else ((), ())))
                score, wide = _scores([scores[p] for p in at])
                yield pa.RecordBatch.from_arrays([pa.array(q_rows[i[at]]), pa.array(q_ids[i[at]]), pa.array(rank.astype(np.int32)), pa.array(c_rows[j[at]]), pa.array(c_ids[j[at]]), score, wide], ["anchor", "anchor_id", "of", "row", "id", "score", "wide"])

    second = common.map_arrow(met(anchors, "exact"), fitting, "anchor long, anchor_id long, of int, row long, id long, score long, wide string")
    ranked = second.withColumn("rank", F.row_number().over(_ranked("anchor", "of"))).where(F.col("rank") <= keep)
    pairs = ranked.join(told.select("anchor", F.col("rank").alias("of"), "positive_id", "positive_score").hint("merge"), ["anchor", "of"])
    return pairs.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def op12_hard_negatives(spark, sf_dir: str) -> DataFrame:
    df = common.table(spark, sf_dir, "embeddings")
    # One label in seven is wrong on purpose.
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = topk.quantise(df.select("vec_id", "embedding", label.alias("label")), scale=256, extra=("label",))
    return mine(rows, F.col("id") % 100 == 0)


OP12_SQL = """
WITH v AS MATERIALIZED (
  SELECT vec_id, row_number() OVER () AS r, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS MATERIALIZED (SELECT q.r AS own, q.vec_id AS anchor_id, c.vec_id, q.label = c.label AS same, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.r <> c.r WHERE q.vec_id % 100 = 0),
p AS (SELECT own, vec_id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY own ORDER BY score DESC, vec_id) AS k FROM s WHERE same),
n AS (SELECT s.anchor_id, p.positive_id, s.vec_id AS negative_id, p.positive_score, s.score AS negative_score,
    CAST(row_number() OVER (PARTITION BY own, k ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank
  FROM p JOIN s USING (own) WHERE k <= 5 AND NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score)
SELECT * FROM n WHERE rank <= 10
"""
