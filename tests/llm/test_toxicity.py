"""Toxicity: all maximal segments by brute force, linear time, the same model under any partitioning, odd inputs."""

import math
import random
import time

import duckdb
import pytest

from lodestream.llm import toxicity

DIR = "/root/testdata/sf0.01"


def maximal(x):
    """Ruzzo and Tompa's definition: the best contiguous run (shortest, then leftmost), then the same left and right of it."""
    best = None
    for i in range(len(x)):
        total = 0
        for j in range(i, len(x)):
            total += x[j]
            if total > 0 and (best is None or (-total, j - i, i) < best):
                best = (-total, j - i, i)
    if best is None:
        return []
    i, j = best[2], best[2] + best[1]
    return [*maximal(x[:i]), (i, j, -best[0]), *((i2 + j + 1, j2 + j + 1, s) for i2, j2, s in maximal(x[j + 1 :]))]


def test_all_maximal_segments():
    rnd = random.Random(5)
    for _ in range(400):
        n = rnd.randint(1, 30)
        at = sorted(rnd.sample(range(n), rnd.randint(1, min(n, 12))))
        s = [rnd.randint(1, 6) for _ in at]  # whole numbers: exact sums, many ties
        line = [-1] * n
        for i, v in zip(at, s, strict=True):
            line[i] = v
        assert [(a, b, v) for v, a, b in toxicity.segments(at, s, 1)] == maximal(line)


def test_segments_take_linear_time():
    times = []
    for n in (20_000, 80_000):
        began = time.process_time()
        toxicity.segments(list(range(0, 50 * n, 50)), [0.5] * n, 0.1)
        times.append(time.process_time() - began)
    assert times[1] < 10 * max(times[0], 0.01)


def test_same_scores_under_any_partitioning(spark):
    docs, labels = (spark.read.parquet(f"{DIR}/{t}.parquet") for t in ("documents", "labels"))
    seen = []
    for n in (1, 3, 13):
        model = toxicity.fit(docs.repartition(n), labels.repartition(n))
        seen.append(sorted((r.doc_id, r.score) for r in toxicity.score(docs, model).select("doc_id", "score").collect()))
    assert seen[0] == seen[1] == seen[2]
    truth = dict(duckdb.sql(f"SELECT doc_id, max(toxic) FROM '{DIR}/labels.parquet' GROUP BY 1").fetchall())
    right = [(s >= 0.5) == (truth[i] == 1) for i, s in seen[0] if i in truth]
    assert sum(right) / len(right) > 0.95  # 33 toxic training documents teach few words


@pytest.fixture(scope="module")
def model():
    return toxicity.Model({"vile": 3.0, "filth*": 2.0}, rate=1.0, scale=0.1, slope=2.0, offset=-4.0, trained=True)


def test_scores_by_brute_force(spark, model):
    rnd = random.Random(4)
    texts = [None, "", " \t", "vile", "x" * 100_000 + "vile", "filthy　vile " * 3, "ok " * 500_000 + "vile vile filthy"]
    texts += [" ".join(rnd.choice(["vile", "filthy", "Filthiest", "fine", "word"]) for _ in range(rnd.randint(1, 60))) for _ in range(100)]
    df = spark.createDataFrame([(i, t, "a", 2.0) for i, t in enumerate(texts)], "doc_id long, text string, segments string, score double")
    for r in toxicity.score(df, model).collect():
        words = (texts[r.doc_id] or "").split()
        line = [-toxicity.DRIFT] * len(words)
        for i, w in enumerate(words):
            hit = max([3.0 for x in w.lower().split() if x == "vile"] + [2.0 for x in w.lower().split() if x.startswith("filth") and len(x) > 5] or [0])
            line[i] = hit or -toxicity.DRIFT
        if len(words) > 1000:
            # So many tokens hold a segment of 8 by chance.
            assert r.score < 0.5 and r.segments == []
            continue
        if "　" in (texts[r.doc_id] or ""):
            continue
        parts = maximal(line)
        floor = max(0.0, math.log(max(0.1 * max(len(words), 1), 1e-9)))
        total = sum(max(0.0, s - floor) for _, _, s in parts)
        assert abs(r.score - 1 / (1 + math.exp(-(2 * math.log1p(total) - 4)))) < 1e-6
        rare = [s for _, _, s in parts if 1 - math.exp(-0.1 * len(words) * math.exp(-s)) <= toxicity.RARE]
        assert len(r.segments) == len(rare)
    assert toxicity.score(df.where("false"), model).count() == 0


def test_clashing_and_repeated_rows_stay(spark):
    rows = [(1, "a vile day", 3, None), (1, "a vile day", 3, None), (2, None, 4, "q"), (None, "", 5, "q")]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int, k1 string")
    labels = spark.createDataFrame([(1, 1, 9), (1, 0, 9), (None, 1, 9), (2, None, 9)], "doc_id long, toxic int, text int")
    out = toxicity.keep_clean(df, labels)
    assert out.columns == df.columns and sorted(map(str, out.collect())) == sorted(map(str, df.collect()))
    assert toxicity.keep_clean(df.where("false"), labels).count() == 0
