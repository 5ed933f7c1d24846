"""Toxic passages by maximum-scoring segments.

Words and word beginnings get log-odds of toxic against clean training documents under an
informative Dirichlet prior (the features' frequencies over both). Features whose log-odds are many
standard errors above zero are the lexicon; a token scores its best feature, any other token a
small negative drift. One linear scan finds all maximal scoring segments of a document
(Ruzzo and Tompa). A segment's tail probability follows an extreme-value law whose rate solves
E[exp(rate * score)] = 1 over the tokens of clean documents and whose scale is fitted to their
expected number of high segments; significant segments are the passages told, and a logistic curve
over the logarithm of the summed evidence gives the score.

Only text enters a score, and the model is a function of the rows alone, however they are dealt.
Defined results: a null or empty text has no evidence and gets the curve's value at zero; without
training rows of both labels every score is 0; repeated rows are scored alike; labels that repeat an
id count as toxic if any says so; of near copies in training the one with the smallest id (then
text) counts; equal sums make no larger segment; a very long text is taken alone, in time and memory
linear in its length; an empty table gives none; other columns are ignored (or kept, by keep_clean).
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .minhash import shingle_sets

#: Labelled rows that training reads at most, chosen by a hash of their ids.
TRAIN_ROWS = 40_000
#: Bytes of text that a task splits into tokens at a time (a longer text is taken alone), and pieces whose scores it remembers.
PART_BYTES, MEMORY = 4_000_000, 200_000
PREFIXES = (4, 5, 6)
DRIFT, TOP, SURE, ODDS = 0.1, 6.0, 3.0, 2.0
#: The largest tail probability of a passage that is told.
RARE = 0.05
_WORD = re.compile(r"[^\W\d_]+")


def features(word: str) -> list[str]:
    return [word, *(word[:n] + "*" for n in PREFIXES if len(word) > n)]


@dataclass
class Model:
    lexicon: dict[str, float] = field(default_factory=dict)
    rate: float = 1.0
    scale: float = 0.1
    slope: float = 0.0
    offset: float = 0.0
    trained: bool = False

    def score(self, evidence: float) -> float:
        return 1 / (1 + math.exp(-max(-60.0, min(60.0, self.slope * math.log1p(evidence) + self.offset)))) if self.trained else 0.0


class _Pieces(dict):
    """Scores of pieces between white space; 0 stands for the drift."""

    def __init__(self, lexicon: dict[str, float]):
        super().__init__()
        self.lexicon = lexicon

    def __missing__(self, piece: str) -> float:
        if len(self) > MEMORY:
            self.clear()
        get = self.lexicon.get
        best = max((get(f, 0.0) for w in _WORD.findall(piece.lower()) for f in features(w)), default=0.0)
        if len(piece) < 64:
            self[piece] = best
        return best


def segments(places: list[int], scores: list[float], drift: float = DRIFT) -> list[tuple[float, int, int]]:
    """All maximal segments (score, first place, last place) of positive scores with `drift` lost at every place between."""
    # Per segment: sums before and after, first and last place, and the segment left of it with a smaller sum before (-1: none).
    low: list[float] = []
    high: list[float] = []
    ends: list[tuple[int, int]] = []
    link: list[int] = []
    total, seen = 0.0, -1
    for at, s in zip(places, scores, strict=True):
        total -= drift * (at - seen - 1)
        left, first = total, at
        total, seen = total + s, at
        j = len(low) - 1
        while True:
            while j >= 0 and low[j] >= left:
                j = link[j]
            if j < 0 or high[j] >= total:
                break
            # What lies between j and here joins j.
            left, first, j, cut = low[j], ends[j][0], link[j], j
            del low[cut:], high[cut:], ends[cut:], link[cut:]
        low.append(left)
        high.append(total)
        ends.append((first, at))
        link.append(j)
    return [(hi - lo, a, b) for lo, hi, (a, b) in zip(low, high, ends, strict=True)]


def found(texts: pa.Array, pieces: _Pieces):
    """For each text its number of tokens, its segments and its tokens' positive scores."""
    for a, b in common.chunks(texts, PART_BYTES):
        yield from _found(texts.slice(a, b - a), pieces)


def _found(texts: pa.Array, pieces: _Pieces):
    split = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    bounds = split.offsets.to_numpy().astype(np.int64)
    coded = split.values.slice(bounds[0], bounds[-1] - bounds[0]).dictionary_encode()
    bounds = bounds - bounds[0]
    score = np.fromiter(map(pieces.__getitem__, coded.dictionary.to_pylist()), float, len(coded.dictionary))
    each = score[coded.indices.to_numpy()] if len(coded) else np.empty(0)
    hits = np.flatnonzero(each)
    cut = np.searchsorted(hits, bounds)
    for i in range(len(bounds) - 1):
        own = hits[cut[i] : cut[i + 1]]
        n = int(bounds[i + 1] - bounds[i])
        yield n, segments((own - bounds[i]).tolist(), each[own].tolist()) if len(own) else [], each[own]


def evidence(model: Model, n: int, parts: list[tuple[float, int, int]]) -> float:
    """Summed log of how much rarer each segment is than one expected in clean text of that length."""
    floor = math.log(max(model.scale * max(n, 1), 1e-9))
    return sum(max(0.0, model.rate * s - max(floor, 0.0)) for s, _, _ in parts)


def tail(model: Model, n: int, s: float) -> float:
    """The chance that clean text of n tokens holds a segment of that score or more."""
    return -math.expm1(-model.scale * max(n, 1) * math.exp(-model.rate * s))


def solve_rate(drift: float, hit: float, weights: Counter) -> float:
    """The positive root of E[exp(rate * score)] = 1 for tokens that score -drift or, with chance hit, by weights."""
    total = sum(weights.values())
    mean = lambda x: (1 - hit) * math.exp(-drift * x) + hit * sum(n * math.exp(x * s) for s, n in weights.items()) / total - 1
    low, high = 1e-4, 8.0
    if mean(low) >= 0:
        return low
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if mean(mid) < 0 else (low, mid)
    return low


def logistic(rows: list[tuple[float, int, int]], ridge: float = 1e-2) -> tuple[float, float]:
    """Slope and offset from (value, label, count); the ridge keeps separable data finite."""
    x = np.array([r[0] for r in rows], float)
    y, w = (np.array([r[i] for r in rows], float) for i in (1, 2))
    scale = max(x.max(), 1e-9)
    design, beta = np.stack([x / scale, np.ones(len(x))], 1), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        slope = design.T @ (w * (y - p)) - ridge * beta
        curve = (design * (w * p * (1 - p))[:, None]).T @ design + ridge * np.eye(2)
        move = np.linalg.solve(curve, slope)
        beta += np.clip(move, -5, 5)
        if np.abs(move).max() < 1e-8:
            break
    return float(beta[0] / scale), float(beta[1])


def held_out(id_col="doc_id"):
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0


def _one_of_copies(train: DataFrame) -> DataFrame:
    """toxic and text of one document of each group of near copies, which would count the same words again.

    Copies agree in the least hash of their three-word shingles, or in the least of a second order.
    """

    def run(batches):
        for batch in batches:
            for a, b in common.chunks(batch.column(2), PART_BYTES):
                keys = [(int(s[0].view(np.int64)), int(common.mix64(s).min().view(np.int64))) if len(s) else (0, 0) for s in shingle_sets(batch.column(2).slice(a, b - a), 3)]
                yield pa.RecordBatch.from_arrays([*batch.slice(a, b - a).columns, *(pa.array([k[i] for k in keys], pa.int64()) for i in (0, 1))], ["doc_id", "toxic", "text", "k1", "k2"])

    kind = train.schema["doc_id"].dataType.simpleString()
    keyed = common.map_arrow(train.select("doc_id", "toxic", "text"), run, f"doc_id {kind}, toxic int, text string, k1 long, k2 long")
    one = keyed.groupBy("toxic", "k1").agg(F.min(F.struct("doc_id", "text", "k2")).alias("row")).select("toxic", "row.*")
    return one.groupBy("toxic", "k2").agg(F.min(F.struct("doc_id", "text")).alias("row")).select("toxic", "row.text")


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    """Learns from at most `rows` labelled documents that are not held out."""
    known = labels.select("doc_id", "toxic").where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out())
    known = known.groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    train = docs.select("doc_id", F.col("text").cast("string").alias("text")).where(~held_out()).join(F.broadcast(known), "doc_id")
    train = common.materialise(_one_of_copies(train), "toxic-train")
    sizes = {r["toxic"]: r["n"] for r in train.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if not sizes.get(0) or not sizes.get(1):
        return Model()

    def count(batches):
        for batch in batches:
            for a, b in common.chunks(batch.column(1), PART_BYTES):
                for label in (0, 1):
                    seen: Counter = Counter()
                    for t, y in zip(batch.column(1).slice(a, b - a).to_pylist(), batch.column(0).slice(a, b - a).to_pylist(), strict=True):
                        if t and y == label:
                            seen.update({f for w in set(_WORD.findall(t.lower())) for f in features(w)})
                    yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array([label] * len(seen), pa.int32()), pa.array(list(seen.values()), pa.int64())], ["feature", "toxic", "n"])

    counts = common.map_arrow(train, count, "feature string, toxic int, n long")
    bad, good, both = sizes[1], sizes[0], sizes[0] + sizes[1]
    side = lambda v: F.sum(F.when(F.col("toxic") == v, F.col("n")).otherwise(0)).cast("double")
    table = counts.groupBy("feature").agg(side(1).alias("y1"), side(0).alias("y0")).where("y1 >= 3")
    strength = max(10.0, both / 20)
    table = table.withColumn("a", (F.col("y1") + F.col("y0")) / both * strength)
    table = table.withColumn("odds", F.log((F.col("y1") + F.col("a")) / (bad + strength - F.col("y1") - F.col("a"))) - F.log((F.col("y0") + F.col("a")) / (good + strength - F.col("y0") - F.col("a"))))
    table = table.withColumn("sure", F.col("odds") / F.sqrt(1 / (F.col("y1") + F.col("a")) + 1 / (F.col("y0") + F.col("a"))))
    kept = table.where((F.col("sure") >= SURE) & (F.col("odds") >= ODDS)).select("feature", "odds").collect()
    model = Model({r["feature"]: round(min(r["odds"], TOP), 6) for r in kept}, trained=True)

    def measure(batches):
        """Per batch: tokens of clean documents, and counts of their positive scores."""
        pieces = _Pieces(model.lexicon)
        for batch in batches:
            tokens, hits = 0, Counter()
            for y, (n, _, scores) in zip(batch.column(0).to_pylist(), found(batch.column(1), pieces), strict=True):
                if y == 0:
                    tokens += n
                    hits.update(np.round(scores, 1).tolist())
            yield pa.RecordBatch.from_arrays([pa.array([0.0, *hits]), pa.array([tokens, *hits.values()], pa.int64())], ["value", "n"])

    clean = common.map_arrow(train, measure, "value double, n long").groupBy("value").agg(F.sum("n").alias("n")).collect()
    tokens = max(1, sum(r["n"] for r in clean if r["value"] == 0))
    hits = Counter({v: n for v, n in sorted((r["value"], r["n"]) for r in clean) if v > 0})  # in one order, as sums of floats depend on it
    hits[2 * TOP / 3] += 1  # one more than seen
    model.rate = solve_rate(DRIFT, min(0.5, sum(hits.values()) / tokens), hits)
    model.scale = sum(hits.values()) / tokens * sum(n * math.exp(model.rate * s) for s, n in hits.items()) / sum(hits.values())

    def weigh(batches):
        pieces = _Pieces(model.lexicon)
        for batch in batches:
            seen = Counter((round(evidence(model, n, parts), 1), y) for y, (n, parts, _) in zip(batch.column(0).to_pylist(), found(batch.column(1), pieces), strict=True))
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in seen], pa.float64()), pa.array([k[1] for k in seen], pa.int32()), pa.array(list(seen.values()), pa.int64())], ["x", "y", "n"])

    seen = common.map_arrow(train, weigh, "x double, y int, n long").groupBy("x", "y").agg(F.sum("n").alias("n")).collect()
    model.slope, model.offset = logistic(sorted((math.log1p(r["x"]), r["y"], r["n"]) for r in seen))
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score and the document's significant segments (tokens first to last, with score and tail probability), most toxic first."""

    def run(batches):
        pieces = _Pieces(model.lexicon)
        for batch in batches:
            for a, b in common.chunks(batch.column(1), PART_BYTES):
                scores, spans = [], []
                for n, parts, _ in found(batch.column(1).slice(a, b - a), pieces):
                    scores.append(model.score(evidence(model, n, parts)))
                    spans.append([{"first": x, "last": y, "score": s, "tail": p} for s, x, y in sorted(parts, key=lambda g: (-g[0], g[1])) if (p := tail(model, n, s)) <= RARE])
                kind = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64()), ("score", pa.float64()), ("tail", pa.float64())]))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(scores, pa.float64()), pa.array(spans, kind)], ["doc_id", "score", "segments"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return common.map_arrow(rows, run, f"doc_id {kind}, score double, segments array<struct<first:long,last:long,score:double,tail:double>>")


def keep_clean(docs: DataFrame, labels: DataFrame, limit: float = 0.5) -> DataFrame:
    """The rows of docs that score below the limit, with their own columns."""
    model = fit(docs, labels)

    def run(batches):
        pieces = _Pieces(model.lexicon)
        at = None
        for batch in batches:
            at = batch.schema.get_field_index("text") if at is None else at
            for a, b in common.chunks(batch.column(at), PART_BYTES):
                part = batch.slice(a, b - a)
                yield part.filter(pa.array([model.score(evidence(model, n, p)) < limit for n, p, _ in found(part.column(at), pieces)], pa.bool_()))

    return common.map_arrow(docs, run, docs.schema)


def op4_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = common.spread(common.table(spark, sf_dir, "documents"))
    scored = score(docs, fit(docs, common.table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
