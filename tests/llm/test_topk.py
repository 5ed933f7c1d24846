"""Exact top-k: large components, repeated ids, odd rows, against brute force in Python's integers."""

import math
import random

import pytest

from lodestream.llm import topk


def brute(rows, k):
    rows = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(64 * x) for x in v)]
    out = []
    for at, (q, v) in enumerate(rows):
        if q % 20 == 0:
            every = sorted((-sum(x * y for x, y in zip(v, w, strict=False)), i) for other, (i, w) in enumerate(rows) if other != at)
            out += [(q, r, i, -s if -(1 << 63) <= -s < 1 << 63 else None) for r, (s, i) in enumerate(every[:k], 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize("size", [1.0, 2e6, 1e12, 1e200])
def test_top_k_is_exact(spark, size):
    rnd = random.Random(int(math.log10(size)))
    rows = [(i // 2 if i < 40 else i, [rnd.uniform(-size, size) for _ in range(8)]) for i in range(600)]
    rows += [(700, None), (720, [None] * 8), (740, [float("nan")] * 8), (None, [1.0] * 8), (760, []), (780, [size] * 3), (800, rows[7][1]), (801, rows[7][1])]
    df = spark.createDataFrame([(*r, 5, 6) for r in rows], "vec_id long, embedding array<double>, row int, score int")
    found = [tuple(r) for r in topk.top_k(topk.quantise(df), "id % 20 = 0").collect()]
    assert sorted(found, key=str) == brute(rows, 20)
    assert topk.top_k(topk.quantise(df.where("false")), "id % 20 = 0").count() == 0


def test_many_rows_of_two_million(spark):
    rnd = random.Random(9)
    rows = [(i, [float(rnd.randint(-2_000_000, 2_000_000)) for _ in range(8)]) for i in range(3000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = [tuple(r) for r in topk.top_k(topk.quantise(df), "id % 20 = 0", 5).collect()]
    assert sorted(found, key=str) == brute(rows, 5)
