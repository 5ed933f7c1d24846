"""The segmented index against a scan of its chunks, over random runs; the log of commits; jobs that are watched and cancelled."""

import random
import time

import pytest
from pyspark.sql import functions as F

from lodestream import tools
from lodestream.operators import encoders, lexical, vector
from lodestream.plans import build
from lodestream.sources import segments, store
from lodestream.sources.manifest import Conflict, Log

CHUNK = "chunk_id long, file_id long, ordinal int, start_line int, end_line int, text string"
QUERIES = ["ana", "banana", "an ana", "an", "bana nan", "zzz ana", "anaNAN", "na na", "検索エンジン", "nn an", "banananana"]


def chunks(spark, rows):
    return segments.shaped(spark.createDataFrame([(f << 24 | o, f, o, 1, 1, t) for f, o, t in rows], CHUNK))


@pytest.mark.parametrize("seed", [1, 2])
def test_search_equals_a_scan_after_random_runs(spark, tmp_path, seed, monkeypatch):
    monkeypatch.setattr(segments, "BLOCK", 8)
    rnd = random.Random(seed)
    text = lambda: "".join(rnd.choice(["an", "ana", "b", "na", " ", "N", "検索", "エンジン", "x\n"]) for _ in range(rnd.randint(1, 40)))
    live, snapshot, log = {}, segments.Snapshot(), Log(spark, str(tmp_path / "index"))
    for number in range(1, 8):
        touched = rnd.sample(range(60), rnd.choice([3, 20, 40]))
        gone = [f for f in touched if rnd.random() < 0.3]
        made = {f: [text() for _ in range(rnd.randint(1, 3))] for f in touched if f not in gone}
        live = {f: t for f, t in live.items() if f not in touched} | made
        run = log.begin()
        rows = [(f, o, t) for f, own in made.items() for o, t in enumerate(own)]
        snapshot = segments.apply(run, snapshot, number, chunks(spark, rows), spark.createDataFrame([(f,) for f in touched], "file_id long"))
        run.commit({"index": snapshot.as_json()})
        log.clean()
        snapshot = segments.Snapshot.from_json(log.state()[1]["index"])
    assert len(snapshot.segments) < 7
    want = sorted((f << 24 | o, t) for f, own in live.items() for o, t in enumerate(own))
    assert sorted((r.chunk_id, r.text) for r in snapshot.chunks(spark).collect()) == want and snapshot.n == len(want) and snapshot.total == sum(max(len(t) - 2, 0) for _, t in want)
    assert all(r.n <= r.held for r in snapshot.postings(spark).groupBy("gram").agg(F.count("*").alias("n")).join(snapshot.blocks(spark).groupBy("gram").agg(F.sum("n").alias("held")), "gram").collect())
    files = spark.createDataFrame([(f, f"/d{f % 3}/{f}.md", None, ".md" if f % 2 else ".txt") for f in range(60)], "file_id long, path string, text_path string, ext string")
    index = store.Index(files, snapshot)
    shown = lambda df: [(r.rank, r.chunk_id, round(r.bm25, 9), r.path, r.score, r.total_candidates) for r in df.orderBy("rank").collect()]
    for q in QUERIES:
        for options in ({}, {"prefix": "/d1"}, {"extensions": ["md"], "limit": 3}):
            ours, scan = lexical.search(index, q, **options), lexical.fulltext(index.chunks, q, **options)
            assert shown(ours) == shown(scan), (q, options)
    asked = spark.createDataFrame(list(enumerate(QUERIES)), "query_id int, query string")
    batch = {i: [] for i in range(len(QUERIES))}
    for r in lexical.fulltext_batch(index, asked, 5).orderBy("query_id", "rank").collect():
        batch[r.query_id].append((r.rank, r.chunk_id))
    for i, q in enumerate(QUERIES):
        if any(len(t) >= 3 for t in q.split()) and all(len(t) >= 3 for t in q.split()):
            assert batch[i] == [(r[0], r[1]) for r in shown(lexical.fulltext(index.chunks, q, 5, relax=False))], q


def test_texts_are_read_for_candidates_only(spark, tmp_path):
    run = Log(spark, str(tmp_path / "index")).begin()
    rows = [(f, 0, f"filler number {f} " + ("lighthouse" if f % 50 == 0 else "other words")) for f in range(400)]
    snapshot = segments.apply(run, segments.Snapshot(), 1, chunks(spark, rows), spark.createDataFrame([], "file_id long"))
    index = store.Index(spark.createDataFrame([(f, f"/{f}.md", None, ".md") for f in range(400)], "file_id long, path string, text_path string, ext string"), snapshot)
    found = lexical._places(index, ["lighthouse"])
    assert "text:string" not in found._jdf.queryExecution().executedPlan().toString() and found.where("f0 > 0").count() == 8
    assert [r.rank for r in lexical.search(index, "lighthouse").collect()] == list(range(1, 9))
    relaxed = lexical.search(index, "lighthouse zzzzz").collect()
    assert len(relaxed) == 8 and {r.note for r in relaxed} == {lexical.RELAXED_NOTE}


def test_one_gram_ends_early_and_exactly(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(segments, "BLOCK", 4)
    rnd = random.Random(3)
    rows = [(f, 0, "abc " * rnd.choice([0, 1, 1, 1, 2, 9]) + "x" * rnd.randint(0, 300)) for f in range(900)]
    run = Log(spark, str(tmp_path / "index")).begin()
    snapshot = segments.apply(run, segments.Snapshot(), 1, chunks(spark, rows), spark.createDataFrame([], "file_id long"))
    index = store.Index(spark.createDataFrame([(f, f"/{f}.md", None, ".md") for f in range(900)], "file_id long, path string, text_path string, ext string"), snapshot)
    read = []
    monkeypatch.setattr(segments.Snapshot, "postings", lambda self, spark, wanted=None, grams=None, own=segments.Snapshot.postings: read.append(wanted) or own(self, spark, wanted, grams))
    ours = [(r.chunk_id, round(r.bm25, 9)) for r in lexical.search(index, "abc", 5).orderBy("rank").collect()]
    assert ours == [(r.chunk_id, round(r.bm25, 9)) for r in lexical.fulltext(index.chunks, "abc", 5).orderBy("rank").collect()]
    assert read and all(w is not None and sum(map(len, w.values())) < 100 for w in read)


def test_vectors_are_encoded_once_and_go_with_their_chunks(spark, tmp_path):
    log, snapshot, told = Log(spark, str(tmp_path / "index")), segments.Snapshot(), []
    texts = {1: ["sea", "night"], 2: ["sea"], 3: ["12"]}
    for number, (made, dead) in enumerate([(texts, []), ({2: ["sea", "storm"]}, [2]), ({}, [1])], 1):
        rows = [(f, o, t) for f, own in made.items() for o, t in enumerate(own)]
        snapshot = segments.apply(log.begin(), snapshot, number, chunks(spark, rows), spark.createDataFrame([(f,) for f in dead], "file_id long"), build.encoding(encoders.LetterEncoder))
        told.append(snapshot.written["encoded"])
    assert told == [3, 1, 0]
    held = {r.chunk_id: len(r.embedding) for r in snapshot.vectors(spark).collect()}
    assert held == {2 << 24: 26, 2 << 24 | 1: 26, 3 << 24: 0}
    asked = spark.createDataFrame([(7, [1.0] + [0.0] * 25), (8, [0.0] * 26)], "query_id long, embedding array<double>").where("query_id = 7")
    got = vector.nearest_batch(snapshot.vectors(spark), asked, 2).orderBy("rank").collect()
    assert [(r.query_id, r.chunk_id) for r in got] == [(7, 2 << 24), (7, 2 << 24 | 1)] and got[0].score == pytest.approx(0.57735)


def test_log_of_commits(spark, tmp_path):
    path = str(tmp_path / "log")
    log = Log(spark, path, keep=1)
    assert log.state() == (0, {}) and log.reconcile() == []
    df = spark.range(3)
    one = log.begin()
    kept = one.keep(df, "rows")
    assert one.commit({"rows": kept.inputFiles()[0].rsplit("/", 1)[0]}) == 1
    slow, fast = log.begin(), log.begin()
    slow.keep(df, "rows")
    fast.keep(df, "scratch")
    assert fast.commit({"rows": "none"}) == 2
    with pytest.raises(Conflict):
        slow.commit({"rows": "other"})
    dead = Log(spark, path).begin()
    dead.keep(df, "rows")
    assert log.reconcile(alive=(dead.name,)) == [] and log.reconcile() == [dead.name]
    assert dict(log.runs()) == {one.name: "completed", fast.name: "completed", slow.name: "lost", dead.name: "interrupted"}
    assert log.state() == (2, {"rows": "none"}) and log.state(1)[1]["rows"].endswith(kept.inputFiles()[0].rsplit("/", 2)[1])
    assert len(log.clean()) == 2 and log.folder.names("data") == []


def test_progress_and_cancel_between_batches(spark, tmp_path, monkeypatch):
    root = tmp_path / "docs"
    root.mkdir()
    for i in range(12):
        (root / f"f{i:02} [x].md").write_text(f"file number {i} tells of the sea\n")
    (root / "bad.docx").write_bytes(b"no archive")
    monkeypatch.setattr(tools.Tools, "BATCH", 3)
    t = tools.Tools(spark, path=str(tmp_path / "index"))
    own = t.add_search_path(str(root))
    job, seen = t.start_indexing(), []
    while job.state == "running":
        seen.append(t.get_index_status()["scanned"])
        if seen[-1] >= 3:
            t.cancel_indexing()
        time.sleep(0.05)
    t._thread.join()
    assert job.state == "cancelled" and seen == sorted(seen) and 3 <= job.counts["scanned"] < 13
    done = t.get_index_status()
    assert done["files"] == job.counts["scanned"] and t.search_fulltext("tells").count() == done["all_chunks"] == job.counts["indexed"]
    # Another object goes on where the commits stand, and files gone are dropped only by a whole walk.
    again = tools.Tools(spark, path=str(tmp_path / "index"))
    assert again.get_index_status()["files"] == done["files"]
    (root / "f00 [x].md").unlink()
    again.add_search_path(own)
    job = again.start_indexing(wait=True)
    assert job.state == "completed" and again.get_index_status()["files"] == 12 and job.recent_errors == [f"{own}/bad.docx: unreadable"] and job.counts["failed"] == 1
    assert again.search_fulltext("sea", limit=50).count() == 11


def test_postings_are_one_row_a_gram_and_block(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(segments, "BLOCK", 8)
    rows = [(f, 0, "the night sea " + "tide " * (f % 3)) for f in range(40)]
    snapshot = segments.apply(Log(spark, str(tmp_path / "index")).begin(), segments.Snapshot(), 1, chunks(spark, rows), spark.createDataFrame([], "file_id long"))
    held = spark.read.parquet(snapshot.segments[0].postings).groupBy("gram", "block").count()
    assert held.count() and not held.where("count > 1").count()
    text = {f << 24: t for f, _, t in rows}
    told = {(r.gram, r.chunk_id): (r.dl, r.places) for r in snapshot.postings(spark).collect()}
    brute = {}
    for i, t in text.items():
        for _, g, at in zip(*(x.tolist() for x in segments.keys([t])), strict=True):
            brute.setdefault((g, i), (len(t) - 2, []))[1].append(at)
    assert told == brute


def test_postings_are_made_in_place_and_are_small(spark, tmp_path):
    rows = [(f, 0, " ".join(random.Random(f).choices(["lighthouse", "harbour", "the", "night", "sea", "tide", "of", "winter"], k=120))) for f in range(300)]
    made = chunks(spark, rows)
    plan = segments.posted(made, 10**6)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Sort" not in plan
    snapshot = segments.apply(Log(spark, str(tmp_path / "index")).begin(), segments.Snapshot(), 1, made, spark.createDataFrame([], "file_id long"))
    held = spark.read.parquet(snapshot.segments[0].postings)
    assert held.agg(F.sum(F.length("body"))).first()[0] < 3 * sum(len(t) for _, _, t in rows)


def test_vector_searches_build_no_postings(spark, monkeypatch):
    from lodestream.plans import search

    def none(*_):
        raise AssertionError("an index was built")

    monkeypatch.setattr(store, "index_of", none)
    assert search.QUERIES["knn_l2"](spark, "/root/testdata/sf0.001").count() == 10


def test_vectors_runs_build_no_postings(spark, monkeypatch):
    def none(*_):
        raise AssertionError("postings were built")

    monkeypatch.setattr(segments, "posted", none)
    monkeypatch.setattr(build, "_made", {})
    rows = build.index_vectors_runs(spark, "/root/testdata/sf0.001").orderBy("run").collect()
    assert rows[0].written_encoded and rows[3].written_encoded and [rows[i].written_encoded for i in (1, 2, 4)] == [0, 0, 0]


def test_vectors_in_parts_are_those_of_each_text_encoded_once(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(segments, "PART", 4)
    log, snapshot, known = Log(spark, str(tmp_path / "index")), segments.Snapshot(), set()
    word = lambda n: "".join(random.Random(n).choices("abcdefgh", k=9))
    for number, files in enumerate((range(0, 20), range(10, 30), range(10, 30)), 1):
        rows = [(f, o, word((f * 3 + o * number) % 23)) for f in files for o in range(3)]
        run = log.begin()
        dead = spark.createDataFrame([(f,) for f in files], "file_id long")
        snapshot = segments.apply(run, snapshot, number, chunks(spark, rows), dead, build.encoding(encoders.LetterEncoder), False)
        texts = {t for _, _, t in rows}
        assert snapshot.written["encoded"] == len(texts - known)
        known |= texts
        # Nothing is left besides what the segment is made of.
        assert {n.rpartition("-")[0] for n in log.folder.names(f"data/{run.name}")} <= {"chunks", "vectors", "tombstones"}
    text = {r.chunk_id: r.text for r in snapshot.chunks(spark).collect()}
    held = {r.chunk_id: r.embedding for r in snapshot.vectors(spark).collect()}
    assert held.keys() == text.keys() and len(text) == snapshot.n == snapshot.vectors(spark).count()
    assert all(held[i] == pytest.approx(encoders.LetterEncoder().encode([t])[0]) for i, t in text.items())


def test_new_texts_alone_are_shuffled_for_vectors(spark, tmp_path, monkeypatch):
    log, rows, asked = Log(spark, str(tmp_path / "index")), [(f, 0, f"text {f}") for f in range(9)], []
    none = spark.createDataFrame([], "file_id long")
    encode = build.encoding(encoders.LetterEncoder)
    first = segments.apply(log.begin(), segments.Snapshot(), 1, chunks(spark, rows), none, encode, False)
    # A run that makes known texts anew asks nothing of the encoder.
    again = segments.apply(log.begin(), first, 2, chunks(spark, rows), spark.createDataFrame([(f,) for f in range(9)], "file_id long"), lambda new: asked.append(new) or encode(new), False)
    assert not asked and again.written["encoded"] == 0 and again.vectors(spark).count() == 9


def test_texts_as_read_go_before_vectors_and_postings_are_made(spark, tmp_path, monkeypatch):
    log, seen = Log(spark, str(tmp_path / "runs")), []
    under, posted = log.begin(), segments.posted
    monkeypatch.setattr(segments, "posted", lambda *a: seen.append(log.folder.names(f"data/{under.name}")) or posted(*a))
    state, counts = build.run(build.empty(spark), build._snapshot(spark, "/root/testdata/sf0.001", 1), ["/docs"], build.LARGE, under=under, make=encoders.LetterEncoder)
    assert counts["chunks"] and state.index.segments[0].postings and state.index.segments[0].vectors
    assert len(seen) == 1 and not [n for n in seen[0] if n.startswith("read-")]


def test_runs_for_files_and_chunks_build_no_postings_and_shuffle_no_content(spark, monkeypatch):
    def none(*_):
        raise AssertionError("postings were built")

    monkeypatch.setattr(segments, "posted", none)
    monkeypatch.setattr(build, "_made", {})
    rows = build.index_final_state(spark, "/root/testdata/sf0.001").collect()
    counts = build.index_incremental_runs(spark, "/root/testdata/sf0.001").collect()
    assert rows and sum(r.n_chunks for r in rows) > 0 and counts[-1].scanned == len(rows)
    now = build._snapshot(spark, "/root/testdata/sf0.001", 1)
    before = spark.createDataFrame([], build._FILES)
    wide = build.actions(now, before)._jdf.queryExecution().optimizedPlan().toString()
    assert "content" not in build.actions(now, before).columns and "content" not in wide.partition("Join")[0]


def test_runs_in_parts_leave_the_same_and_drop_dead_segments(spark, monkeypatch):
    """No second index beside the old one: a segment that is dead goes with its part, and no tombstone is left."""
    told = []
    monkeypatch.setattr(build, "PARTS", 2)
    for size in (10**12, 2_000):
        monkeypatch.setattr(build, "PART", size)
        monkeypatch.setattr(build, "_made", {})
        state, rows = build._runs(spark, "/root/testdata/sf0.001")
        assert state.index.whole and not state.index.tombstones and sum(s.n for s in state.index.segments) == state.index.n == state.chunks.count()
        index = store.Index(state.files, state.index)
        found = [[(r.rank, r.score, r.total_candidates) for r in lexical.search(index, q).orderBy("rank").collect()] for q in build.ASKED]
        files = sorted(map(tuple, state.files.select("path", "status", "size", "mtime", "hash").collect()))
        told.append(([{k: v for k, v in r.items() if k != "segments"} for r in rows], found, files, sorted(map(tuple, state.chunks.select("ordinal", "start_line", "text").collect()))))
        assert len({s.part for s in state.index.segments}) == (1 if size > 2_000 else build.PARTS)
    assert told[0] == told[1]


def test_a_mostly_dead_segment_is_written_anew(spark, tmp_path):
    log, rows = Log(spark, str(tmp_path / "index")), [(f, 0, f"text of file {f}") for f in range(20)]
    none = spark.createDataFrame([], "file_id long")
    first = segments.apply(log.begin(), segments.Snapshot(), 1, chunks(spark, rows), none)
    again = segments.apply(log.begin(), first, 2, chunks(spark, rows[:16]), spark.createDataFrame([(f,) for f in range(16)], "file_id long"))
    assert again.n == 20 and sorted(s.n for s in again.segments) == [4, 16] and again.whole and again.written["chunks"] == again.written["dead"] == 16
    assert sorted(r.text for r in again.chunks(spark).collect()) == sorted(t for _, _, t in rows)
