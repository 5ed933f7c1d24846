"""Spelling variants against brute force: all pairs, all orders of ties, odd texts."""

import random
import re
import zlib
from collections import Counter

import duckdb

from lodestream.llm import spelling

DIR = "/root/testdata/sf0.001"


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(count, ratio=5):
    out, form = {}, {}
    for w, n in count.items():
        links = [x for x in count if near(w, x)]
        best = min(links, key=lambda x: (-count[x], x), default=None)
        form[w] = best if best and count[best] >= ratio * n else None
        out[w] = (len(links), count[best] if form[w] else None)
    for w, n in count.items():
        root = w
        while form[root]:
            root = form[root]
        yield w, form[w], root, n, *out[w]


def brute_counts(rows, noise):
    count = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(str.maketrans(spelling.UPPER, spelling.LOWER))
            h = zlib.crc32(f"{doc}:{run}".encode())
            if noise and h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            count[run] += 1
    return {w: n for w, n in count.items() if len(w) >= 6 and n >= 5}


def told(df):
    return sorted((tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()), key=repr)


def test_random_words(spark):
    rnd = random.Random(8)
    for letters, size in (("ab", 300), ("abcdeé", 400)):
        count = {"".join(rnd.choice(letters) for _ in range(rnd.randint(6, 8))): rnd.choice([1, 2, 5, 10, 25, 26, 130, 700]) for _ in range(size)}
        df = spark.createDataFrame(list(count.items()), "word string, n long")
        assert told(spelling.variants(df)) == sorted(brute(count), key=repr)
    assert spelling.variants(df.where("false")).count() == 0


def test_chain_of_forms(spark):
    count = {"abcdef" + "x" * i: 5**i for i in range(12)}
    rows = told(spelling.variants(spark.createDataFrame(list(count.items()), "word string, n long")))
    assert rows == sorted(brute(count), key=repr) and {r[2] for r in rows} == {"abcdef" + "x" * 11}


def test_words_of_any_length(spark):
    rnd = random.Random(2)
    long = "".join(rnd.choice("abcdefgh") for _ in range(200_000))
    other = long[:70_000] + "z" + long[70_001:]
    count = {long: 90, other: 5, long[:9] + long[10:]: 6, "a" * 50_000: 30, "a" * 50_001: 2, "b" + "a" * 49_999: 3, long[1:-1]: 4}
    near_to = [(r[0], r[1]) for r in told(spelling.variants(spark.createDataFrame(list(count.items()), "word string, n long")))]
    forms = dict(near_to)
    assert forms[other] == forms[long[:9] + long[10:]] == long and forms["a" * 50_001] == forms["b" + "a" * 49_999] == "a" * 50_000
    assert forms[long] is None and forms[long[1:-1]] is None


def test_odd_tables(spark):
    texts = [None, "", " ", "Straße STRASSE straße " * 5, "wörter wörten " * 30 + "wortes " * 5, "1×2÷3 abcdef÷ " * 5, "harbour " * 40 + "Harbor harbor HARBOR harbor harbor", "x" * 9, None, "ÀÉÎõü " * 6 + "ÀÉÎõüÿ " * 6]
    rows = [(i, t) for i, t in enumerate(texts)] * 2
    df = spark.createDataFrame([(*r, "w", 1) for r in rows], "doc_id long, text string, word string, n long")
    assert told(spelling.variants(spelling.count_words(df, change=spelling.misspelt))) == sorted(brute(brute_counts(rows, True)), key=repr)
    assert told(spelling.variants(spelling.count_words(df))) == sorted(brute(brute_counts(rows, False)), key=repr)
    nulls = spark.createDataFrame([(None, "harbours " * 6)], "doc_id long, text string")
    assert [(r[0], r[3]) for r in told(spelling.variants(spelling.count_words(nulls)))] == [("harbours", 6)]


def test_query_is_its_sql(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS FROM '{DIR}/documents.parquet'")
    rel = con.sql(spelling.OP11_SQL).select("word, form, root, n, n_near, form_n")
    found = told(spelling.op11_spelling(spark, DIR))
    assert found == sorted(rel.fetchall(), key=repr) and any(r[1] for r in found)
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DIR}/documents.parquet").collect()]
    count = brute_counts(rows, True)
    assert {r[0]: r[3] for r in found} == count
