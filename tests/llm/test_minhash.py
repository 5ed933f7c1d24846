"""Near-duplicates: repeated ids, null ids, members that the stars leave apart, recall."""

import random

import duckdb
import numpy as np
import pyarrow as pa

from lodestream.llm import common, minhash


def brute(rows, words, share, parts):
    """doc_id to the smallest id reachable, over all pairs of rows; rows of one id are linked."""
    sets = []
    for i, t in rows:
        w = [x for x in "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").replace("\t", " ").replace("\n", " ").split(" ") if x]
        sets.append((i, {tuple(w[j : j + words]) for j in range(max(1, len(w) - words + 1))} if w else set()))
    top = {i: i for i, _ in rows if i is not None}

    def find(v):
        while top[v] != v:
            v = top[v]
        return v

    for x, (i, s) in enumerate(sets):
        for j, t in sets[:x]:
            if None not in (i, j) and s and t:
                n = len(s & t)
                if i != j and n * parts >= (len(s) + len(t) - n) * share:
                    p, q = sorted((find(i), find(j)))
                    top[q] = p
    return {i: find(i) for i in top}


def test_repeated_and_null_ids(spark):
    w, v = [f"w{i}" for i in range(60)], [f"v{i}" for i in range(60)]
    rows = [(1, " ".join(w)), (1, " ".join(v)), (2, " ".join([*w, "z"])), (3, " ".join([*v, "z"])), (4, "other words that stand alone here"), (None, " ".join(w)), (4, None), (5, "")]
    df = spark.createDataFrame([(*r, "x", 7) for r in rows], "doc_id long, text string, node string, hub int")
    found = minhash.near_duplicates(df, 3, (85, 100)).collect()
    assert len(found) == len(rows)
    assert {r.doc_id: r.component_id for r in found if r.doc_id} == brute(rows, 3, 85, 100) == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5}
    assert [(r.component_id, r.kept) for r in found if r.doc_id is None] == [(None, None)]
    one = minhash.keep_one(df, 3, (85, 100))
    kept = one.collect()
    assert one.columns == df.columns and sorted(r.doc_id or 0 for r in kept) == [0, 1, 4, 5]
    again = minhash.keep_one(df.repartition(7), 3, (85, 100)).collect()
    assert sorted(map(str, kept)) == sorted(map(str, again))
    assert minhash.keep_one(df.where("false")).count() == 0 == minhash.near_duplicates(df.where("false")).count()


def test_members_the_stars_leave_apart(spark, monkeypatch):
    """5,000 variants of one text, many pairs just above or below four fifths; blocks of bounded size, output linear in members."""
    rnd = random.Random(11)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(5000):
        words = list(base)
        for _ in range(rnd.randint(1, 5)):
            words[rnd.randrange(120)] = f"n{rnd.randint(0, 10**6)}"
        rows.append((i, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept, made = common.Space.keep, {}

    def watch(self, df, name):
        out = kept(self, df, name)
        made[name] = max(made.get(name, 0), out.count())
        return out

    monkeypatch.setattr(common.Space, "keep", watch)
    monkeypatch.setattr(minhash, "BLOCK", 256)
    found = {r.doc_id: r.component_id for r in minhash.near_duplicates(df).collect()}
    assert made["more"] <= made["likely"] <= 16 * made["rest"] and made["links"] <= 35 * 5000
    # Brute force over hashed sets, all pairs by matrix products.
    sets = list(minhash.shingle_sets(pa.array([t for _, t in rows]), 5))
    names, at = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    common_names = np.flatnonzero(np.bincount(at) > 1)
    column = np.full(len(names), -1)
    column[common_names] = np.arange(len(common_names))
    held = np.zeros((len(sets), len(common_names)), np.float32)
    use = column[at] >= 0
    held[row[use], column[at[use]]] = 1
    n = np.array([len(s) for s in sets])
    label = np.arange(len(sets))
    linked = []
    for a in range(0, len(sets), 500):
        inner = np.rint(held[a : a + 500] @ held.T)
        linked += [(a + i, np.flatnonzero(5 * inner[i] >= 4 * (n[a + i] + n - inner[i]))) for i in range(len(inner))]
    while True:
        new = np.array([min(label[i], label[js].min(initial=label[i])) for i, js in linked])
        new = np.minimum(new, new[new])
        if (new == label).all():
            break
        label = new
    assert found == dict(enumerate(label.tolist()))


def test_bound_is_never_below_the_intersection():
    rnd = np.random.default_rng(3)
    for _ in range(200):
        pool = np.unique(rnd.integers(0, 1 << 63, 3000).astype(np.uint64) * np.uint64(2))
        s, t = (np.sort(rnd.choice(pool, rnd.integers(1, 2500), replace=False)) for _ in range(2))
        c = [np.frombuffer(minhash.counts_of(x), "<u2").astype(int) for x in (s, t)]
        w = min(map(len, c))
        fold = [x.reshape(w, -1).sum(1) for x in c]
        assert np.minimum(*fold).sum() >= len(np.intersect1d(s, t))


def test_recall_at_four_fifths_of_five_words(spark):
    """All pairs of sf0.01 that four fifths of their five-word shingles link are found (README states this)."""
    sf = "/root/testdata/sf0.01/documents.parquet"
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{sf}'").fetchall()
    found = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.read.parquet(sf)).collect()}
    sql = minhash.OP2_SQL.replace("len(w) < 3", "len(w) < 5").replace("len(w) - 1)", "len(w) - 3)").replace("w[i + 2])", "w[i + 2], w[i + 3], w[i + 4])").replace("100 * count(*) >= 85", "5 * count(*) >= 4")
    documents = spark.createDataFrame(rows, "doc_id long, text string").toPandas()  # noqa: F841
    assert found == {r[0]: r[2] for r in duckdb.sql(sql).fetchall()}
