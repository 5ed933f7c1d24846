"""Re-Pair shards: round trips, random access by stored lengths, and that no frequent pair is left."""

import random
from collections import Counter

import numpy as np
import pytest

from lodestream.llm import repair


def corpus(seed, docs=60, top=50, size=300):
    rnd = random.Random(seed)
    phrases = [[rnd.randrange(top) for _ in range(rnd.randint(2, 12))] for _ in range(15)]
    out = []
    for _ in range(docs):
        doc = []
        while len(doc) < rnd.randint(0, size):
            doc += rnd.choice(phrases) if rnd.random() < 0.7 else [rnd.randrange(top)] * rnd.randint(1, 9)
        out.append(doc)
    return np.array([x for d in out for x in d], np.uint32), np.cumsum([0, *map(len, out)]), out


@pytest.mark.parametrize("top", [50, 49_000, 70_000])
@pytest.mark.parametrize("new", [3, 4096])
def test_whole_and_random_access(top, new):
    flat, bounds, docs = corpus(top + new, top=top)
    shard = repair.Shard(repair.compress(flat, bounds, new=new))
    got, at = shard.all()
    assert (got == flat).all() and (at == bounds).all()
    rnd = random.Random(1)
    for i, d in enumerate(docs):
        assert shard.document(i).tolist() == d
        for _ in range(5):
            a = rnd.randint(0, len(d))
            n = rnd.randint(0, len(d) + 3)
            assert shard.document(i, a, n).tolist() == d[a : a + n]


@pytest.mark.parametrize("new", [3, 4096])
def test_no_frequent_pair_is_left(new):
    flat, bounds, _ = corpus(7, docs=200)
    shard = repair.Shard(repair.compress(flat, bounds, new=new))
    count = Counter()
    for i in range(len(bounds) - 1):
        part = shard.seq[shard.ends[i] - shard.per_doc[i] : shard.ends[i]].tolist()
        at = 0
        while at < len(part) - 1:  # occurrences of a chain as they are replaced: x x x is one
            count[part[at], part[at + 1]] += 1
            at += 1 + (part[at : at + 3] == [part[at]] * 3)
    assert max(count.values()) < repair.LEAST


def test_many_waiting_pairs():
    """More pairs wait than a 16-bit place could tell; none that is frequent is left while symbols are free."""
    flat = np.random.default_rng(4).integers(0, 300, 1_000_000).astype(np.uint32)
    shard = repair.Shard(repair.compress(flat, np.array([0, len(flat)])))
    assert (shard.all()[0] == flat).all() and len(shard.rules) < 65_000 - 300
    seq = shard.seq.astype(np.uint64)
    _, n = np.unique((seq[:-1] << np.uint64(32)) | seq[1:], return_counts=True)
    # A chain of one symbol holds half as many occurrences as pairs.
    assert (n >= 2 * repair.LEAST).sum() == 0 and (n >= repair.LEAST).sum() <= 3


def test_one_long_document_and_odd_shards():
    flat = np.full(3_000_000, 7, np.uint32)
    blob = repair.compress(flat, np.array([0, 3_000_000]))
    shard = repair.Shard(blob)
    assert len(blob) < 2000 and (shard.all()[0] == flat).all() and shard.document(0, 2_999_998, 9).tolist() == [7, 7]
    for docs in ([], [[]], [[1]], [[1], [], [1, 1]]):
        flat = np.array([x for d in docs for x in d], np.uint32)
        shard = repair.Shard(repair.compress(flat, np.cumsum([0, *map(len, docs)])))
        assert [shard.document(i).tolist() for i in range(len(docs))] == docs


def test_shards_of_odd_tables(spark):
    rows = [(2, "same text", "x"), (2, "same text", "x"), (None, None, "x"), (1, "", "x"), (3, "word " * 1_200_000, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, file string")
    found = repair.read_shards(repair.write_shards(df)).orderBy("start").select("doc_id", "start", "n_tokens").collect()
    assert [r.doc_id for r in found] == [None, 1, 2, 2, 3] and found[-1].n_tokens > 1_000_000
    at = 0
    for r in found:
        assert r.start == at
        at += r.n_tokens
    assert repair.read_shards(repair.write_shards(df.where("false"))).count() == 0
