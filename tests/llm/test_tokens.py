"""Packing and coding of whole tables against the tokenizers library, and of odd tables."""

import duckdb
import numpy as np
from lodestream.llm import bpe, packing
from lodestream.llm.tokens import encoder, vocabulary

ROWS = [(1, None, b"i", 1), (1, "", b"i", 1), (2, "same words", b"i", 1), (2, "same words", b"i", 1), (None, "no id", b"i", 1), (3, "a long text, İ中 " * 120_000, b"i", 1), (4, "x" * 200_000, b"i", 1)]


def ids_of(text):
    return np.array(encoder(vocabulary()).lib.encode(text or "", add_special_tokens=False).ids, "<u4")


def test_whole_table_is_coded_as_the_library_does(spark):
    path = "/root/testdata/sf0.01/documents.parquet"
    texts = dict(duckdb.sql(f"SELECT doc_id, text FROM '{path}'").fetchall())
    lib = encoder(vocabulary()).lib
    for r in bpe.decode(bpe.encode(spark.read.parquet(path))).collect():
        own = ids_of(texts[r.doc_id])
        assert bytes(r.ids) == own.tobytes() and r.decoded == lib.decode(own.tolist(), skip_special_tokens=False)


def test_odd_tables(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, ids binary, task long")
    want = sorted((r[0] or 0, ids_of(r[1]).tobytes()) for r in ROWS)
    assert sorted((r.doc_id or 0, bytes(r.ids)) for r in bpe.encode(df).collect()) == want
    pieces = packing.pack(df).collect()
    joined = {}
    for r in sorted(pieces, key=lambda r: (r.sequence_id, r.offset)):
        joined.setdefault(r.doc_id or 0, []).append(bytes(r.ids))
    end = np.array([1], "<u4").tobytes()
    whole = {}
    for i, own in want:
        whole.setdefault(i, []).append(own + end)
    assert {i: len(b"".join(x)) for i, x in joined.items()} == {i: len(b"".join(x)) for i, x in whole.items()}
    assert b"".join(joined[3]) == whole[3][0] and b"".join(joined[4]) == whole[4][0]
    assert max(r.offset + r.length for r in pieces) <= 2048
    assert packing.pack(df.where("false")).count() == bpe.encode(df.where("false")).count() == 0
