"""Hard negatives against brute force in Python's integers: ties, repeated ids, odd rows, components of any size."""

import math
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from lodestream.llm import negatives, topk

DIR = "/root/testdata/sf0.01"


def fits(s):
    return s if -(1 << 63) <= s < 1 << 63 else None


def brute(rows, every, positives, keep):
    rows = [(i, g, [math.floor(256 * x) for x in v]) for i, v, g in rows if i is not None and g is not None and v is not None and all(x is not None and math.isfinite(256 * x) for x in v)]
    out = []
    for at, (a, label, v) in enumerate(rows):
        if a % every:
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, w, strict=False)), i, o, g) for o, (i, g, w) in enumerate(rows) if o != at)
        for p in [x for x in scored if x[3] == label][:positives]:
            inside = [x for x in scored if x[3] != label and 30 * -p[0] <= 100 * -x[0] <= 90 * -p[0]][:keep]
            out += [(a, p[1], r, x[1], fits(-p[0]), fits(-x[0])) for r, x in enumerate(inside, 1)]
    return sorted(out, key=repr)


def mined(spark, rows, every, positives, keep):
    df = spark.createDataFrame([(*r, 7) for r in rows], "vec_id long, embedding array<double>, label int, row int")
    out = negatives.mine(topk.quantise(df, 256, extra=("label",)), F.col("id") % every == 0, positives, keep)
    return sorted((tuple(r) for r in out.collect()), key=repr)


@pytest.mark.parametrize("size", [1.0, 0.02, 1e7, 1e12, 1e200])
def test_mining_is_exact(spark, size):
    rnd = random.Random(int(math.log10(size)))
    rows = [(i // 2 if i < 60 else i, [rnd.uniform(-size, size) for _ in range(6)], rnd.choice([0, 0, 0, 1, 2])) for i in range(400)]
    rows += [(500, None, 1), (510, [None] * 6, 1), (520, [float("nan")] * 6, 1), (None, [1.0] * 6, 1), (530, [size] * 6, None), (540, [], 1), (550, [size] * 3, 2), (560, rows[7][1], 2), (561, rows[7][1], 0)]
    rows += [(570, [0.0] * 6, 3), (571, [0.0] * 6, 3), (580, [size / 3] * 6, 4)]
    assert mined(spark, rows, 10, 5, 10) == brute(rows, 10, 5, 10)
    assert mined(spark, rows, 10, 1, 1) == brute(rows, 10, 1, 1)
    assert mined(spark, rows[:0], 10, 5, 10) == []


def test_many_ties_and_one_large_label(spark):
    rnd = random.Random(4)
    rows = [(i, [float(rnd.randint(0, 2)) / 16 for _ in range(8)], 0 if i % 3 == 0 else i % 5) for i in range(2000)]
    assert mined(spark, rows, 50, 3, 4) == brute(rows, 50, 3, 4)


def test_blocks_do_not_matter(spark, monkeypatch):
    rnd = random.Random(6)
    rows = [(i, [rnd.gauss(0, 1) for _ in range(16)], i % 4) for i in range(700)]
    for name, value in (("ANCHORS", 3), ("ROWS", 50), ("GROUP", 2)):
        monkeypatch.setattr(negatives, name, value)
    assert mined(spark, rows, 20, 5, 10) == brute(rows, 20, 5, 10)


def test_query_is_its_sql(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS FROM '{DIR}/embeddings.parquet'")
    names = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    found = negatives.op12_hard_negatives(spark, DIR).select(*names).collect()
    assert sorted(map(tuple, found)) == sorted(con.sql(negatives.OP12_SQL).select(", ".join(names)).fetchall()) and found


def test_blocks_are_never_broadcast(spark):
    df = spark.createDataFrame([(i, [float(i % 7), 1.0], i % 2) for i in range(300)], "vec_id long, embedding array<double>, label int")
    rows = topk.quantise(df, 256, extra=("label",))
    for out in (negatives.mine(rows, F.col("id") % 100 == 0), topk.top_k(rows, "id % 20 = 0")):
        assert out.count()
        assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()
