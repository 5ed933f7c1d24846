"""The pipeline's stages against brute force, and on odd tables."""

import importlib.util
import pathlib

import corpus_pipeline
import numpy as np
from lodestream.llm import common, pii, toxicity
from lodestream.llm.tokens import encoder, vocabulary

SF = "/root/testdata/sf0.001"


def _other(name):
    spec = importlib.util.spec_from_file_location(name, pathlib.Path(__file__).parent / f"{name}.py")
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    return module


def redacted(text):
    """The base spans replaced from left to right; one that begins inside another is skipped."""
    if text is None:
        return None
    spans = sorted((int(a), int(b), pii.KINDS.index(k)) for k, a, b in (x.split(":") for x in _other("test_ops").base_pii(text).split(",") if x))
    out, at = "", 0
    for a, b, k in spans:
        if a >= at:
            out += text[at:a] + f"[{pii.KINDS[k].upper()}]"
        at = max(at, b)
    return out + text[at:]


def test_stages_against_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        assert name == "packing" or out.columns == docs.columns
        out.write.parquet(str(tmp_path / name))
        kept[name] = (docs, spark.read.parquet(str(tmp_path / name)))
        docs = kept[name][1]
    rows = lambda df: {r.doc_id: r.text for r in df.select("doc_id", "text").collect()}
    before, after = kept["toxicity"]
    model = toxicity.fit(before, spark.read.parquet(f"{SF}/labels.parquet"))
    assert set(rows(after)) == {r.doc_id for r in toxicity.score(before, model).collect() if r.score < 0.5}
    before, after = map(rows, kept["near_duplicates"])
    assert set(after) == {i for i, c in _other("test_minhash").brute(list(before.items()), 5, 4, 5).items() if i == c}
    before, after = kept["pii"]
    plain = {r.doc_id for r in pii.find(before).collect() if r.base == r.spans}
    assert len(plain) > 100 and all(rows(after)[i] == redacted(t) for i, t in rows(before).items() if i in plain)
    before, pieces = rows(kept["packing"][0]), kept["packing"][1].collect()
    ids = {i: np.array([*encoder(vocabulary()).lib.encode(t or "", add_special_tokens=False).ids, 1], "<u4") for i, t in before.items()}
    assert all(bytes(r.ids) == ids[r.doc_id][r.start : r.start + r.length].tobytes() for r in pieces) and sum(r.length for r in pieces) == sum(map(len, ids.values()))
    ran = corpus_pipeline.run(spark, SF)
    assert sorted((r.doc_id, r.start, r.length) for r in ran.collect()) == sorted((r.doc_id, r.start, r.length) for r in pieces)


def test_stages_on_odd_tables(spark):
    text = "one two three four five six seven eight nine ten a@b.co"
    rows = [(1, text, "x", 1), (1, text, "x", 1), (1, "another text of its own with many words in it", "x", 2), (2, text + " more", None, 3), (3, None, "x", None), (4, "", "x", 0), (None, text, "x", 5), (5, "long " * 1_000_000, "x", 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, node string, label int")
    for name, stage in corpus_pipeline.STAGES:
        out = common.materialise(stage(spark, docs, SF), "odd")
        if name != "packing":
            assert out.columns == docs.columns
        if name == "near_duplicates":
            assert sorted(r.doc_id or 0 for r in out.collect()) == [0, 1, 3, 4, 5]
        if name == "pii":
            assert [r.text for r in out.where("doc_id IS NULL").collect()] == [text.replace("a@b.co", "[EMAIL]")]
        assert stage(spark, docs.where("false"), SF).count() == 0
        docs = out
    assert {r.doc_id for r in docs.collect()} == {None, 1, 3, 4, 5}
