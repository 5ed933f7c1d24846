"""The tools over a folder of files: scans, runs, searches, jobs, roots."""

import io
import os
import zipfile

import pytest

from lodestream import tools
from lodestream.operators import encoders
from lodestream.sources import files, journals, writeback


def docx(*paragraphs):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        body = "".join(f"<w:p><w:r><w:t>{p}</w:t></w:r></w:p>" for p in paragraphs)
        z.writestr("word/document.xml", f'<w:document xmlns:w="urn:w">{body}</w:document>')
    return out.getvalue()


@pytest.fixture
def folder(tmp_path):
    root = tmp_path / "docs"
    (root / "sub" / ".hidden").mkdir(parents=True)
    (root / "node_modules").mkdir()
    (root / "a.md").write_text("# Title\nthe quick search engine\n" * 5)
    (root / "sub" / "b.TXT").write_bytes("検索エンジンの設計と評価".encode("cp932"))
    (root / "sub" / "c.docx").write_bytes(docx("office search words", "second line"))
    (root / "broken.docx").write_bytes(b"no archive")
    (root / "skip.exe").write_text("x")
    for hidden in (root / "sub" / ".hidden" / "d.md", root / "node_modules" / "e.md"):
        hidden.write_text("never seen")
    os.symlink(root, root / "sub" / "loop")
    return root


def counts(job):
    return {k: job.counts[k] for k in ("scanned", "indexed", "skipped", "failed", "removed")}


def test_runs_over_a_folder(spark, folder):
    t = tools.Tools(spark, encoders.LetterEncoder())
    own = t.add_search_path(str(folder))
    with pytest.raises(ValueError):
        t.add_search_path(str(folder / "sub"))
    with pytest.raises(ValueError):
        t.start_indexing(["/nowhere"])
    job = t.start_indexing(wait=True)
    assert job.state == "completed" and counts(job) == {"scanned": 4, "indexed": 3, "skipped": 0, "failed": 1, "removed": 0}
    assert counts(t.start_indexing(wait=True)) == {"scanned": 4, "indexed": 0, "skipped": 3, "failed": 1, "removed": 0}
    os.utime(folder / "a.md", (1, 1))
    assert counts(t.start_indexing(wait=True))["indexed"] == 0
    (folder / "a.md").write_text("another text altogether about lighthouses\n")
    (folder / "sub" / "b.TXT").unlink()
    assert counts(t.start_indexing([own], wait=True)) == {"scanned": 3, "indexed": 1, "skipped": 1, "failed": 1, "removed": 1}
    assert counts(t.start_indexing(mode="full", wait=True))["indexed"] == 2
    assert [tuple(r) for r in t.list_search_paths().collect()] == [(1, own, True, 2, 1, 0)]
    hits = t.search_fulltext("lighthouses").collect()
    assert [(r.rank, r.path, r.start_line, r.end_line, r.total_candidates, r.note) for r in hits] == [(1, f"{own}/a.md", 1, 1, 1, None)]
    assert t.search_fulltext("quick").count() == 0
    office = t.search_fulltext("office", extensions=["docx"]).first()
    assert office.path.endswith("c.docx") and office.text_path.endswith(".txt")
    assert t.search_semantic("lighthouses").first().rank == 1 and t.search_hybrid("lighthouses").where("rank = 1").first().fts_rank == 1
    assert t.get_index_status()["files"] == 3
    assert t.remove_search_path(own) and not t.remove_search_path(own) and t.get_index_status()["all_chunks"] == 0
    with pytest.raises(ValueError):
        t.search_fulltext("x", limit=51)


def test_walk_of_many_folders_and_links(spark, tmp_path):
    root = tmp_path / "tree"
    want = set()
    for i in range(400):
        at = root / f"a{i % 7}" / f"b{i % 13}" / f"c{i}"
        at.mkdir(parents=True)
        (at / "f.md").write_text("x" * i)
        want.add((f"{at}/f.md", i))
    for hidden in (root / ".git", root / "a1" / "Library", root / "a2" / "venv"):
        hidden.mkdir(parents=True)
        (hidden / "g.md").write_text("no")
    os.symlink(root, root / "a1" / "loop")
    os.symlink(root / "a2", root / "a3" / "other")
    os.symlink(root / "a2" / "b2" / "nothing", root / "broken.md")
    (root / "a1" / "UPPER.TXT").write_text("yes")
    want.add((f"{root}/a1/UPPER.TXT", 3))
    assert {(r.path, r.size) for r in files.walk(spark, str(root)).collect()} == want
    assert files.walk(spark, str(root / "a1"), recursive=False).count() == 1 and files.walk(spark, str(root / "nowhere")).count() == 0


def test_write_back_in_two_phases(spark, tmp_path):
    paths = [str(tmp_path / f"d{i}" / "s.json") for i in range(6)]
    rows = lambda *texts: spark.createDataFrame(list(zip(paths, texts, strict=False)), "path string, raw string").repartition(3)
    held = lambda: {p.relative_to(tmp_path).as_posix(): p.read_text() for p in sorted(tmp_path.rglob("*.*"))}
    writeback.write(rows(*"abcdef"), str(tmp_path))
    first = held()
    assert first == {f"d{i}/s.json": c for i, c in enumerate("abcdef")}
    writeback.write(rows(*"ABCDEF"), str(tmp_path), dry_run=True)
    with pytest.raises(Exception, match="no text"):
        writeback.write(rows(*"ABCDE", None), str(tmp_path))
    assert held() == first
    writeback.write(rows("a", *"BCDEF"), str(tmp_path))
    assert held() == {"d0/s.json": "a"} | {f"d{i}/s.json": c for i, c in enumerate("aBCDEF") if i} | {f"d{i}/s.json.bak": c for i, c in enumerate("abcdef") if i}


def test_jobs(spark, folder):
    t = tools.Tools(spark)
    t.add_search_path(str(folder))
    assert t.get_index_status()["state"] == "idle" and not t.cancel_indexing()
    job = t.start_indexing()
    with pytest.raises(RuntimeError):
        t.start_indexing()
    assert t.cancel_indexing()
    t._thread.join()
    assert job.state == "cancelled"
    with pytest.raises(RuntimeError):
        t.search_semantic("x")
    runs = spark.createDataFrame([(1, "running"), (2, "completed")], "run_id int, state string")
    assert [r.state for r in tools.reconciled(runs).orderBy("run_id").collect()] == ["interrupted", "completed"]


def test_roots_and_log_days(spark, folder, tmp_path):
    for bad in ("", "relative/path", str(folder / "a.md"), str(tmp_path / "none")):
        with pytest.raises(ValueError):
            files.validate_root(bad, [])
    assert files.validate_root(f"{folder}/sub/..", []) == str(folder)
    with pytest.raises(ValueError):
        files.validate_root(str(tmp_path), [str(folder)])
    assert files.keep(files.scan(spark, str(folder)).select("path"), str(folder), recursive=False).count() == 2
    assert not journals.delete_day(spark, str(tmp_path / "log"), "yesterday")


def test_encoder_dimension_and_judges(spark):
    class Wrong(encoders.LetterEncoder):
        dim = 3

    df = spark.createDataFrame([("a",), (None,)], "text string")
    with pytest.raises(Exception, match="3 numbers"):
        df.select(encoders.encoded(df.text, Wrong)).collect()

    class Gone(encoders.LetterEncoder):
        def encode(self, texts):
            raise RuntimeError("no model")

    assert encoders.query_vector("x", Gone()) is None
