"""Rules case by case: states of a repository, secret paths, first lines, widths, scans, branches."""

import os

import pytest
from pyspark.sql import functions as F

from lodestream.functions import diffs, text
from lodestream.plans import audit, logs, rules
from lodestream.sources import files


def told(spark, make, values):
    rows = spark.createDataFrame(list(enumerate(values)), "i int, v string")
    return [r.x for r in rows.select("i", make(F.col("v")).alias("x")).orderBy("i").collect()]


HEAD, UP = "# branch.oid 1a\n# branch.head main", "\n# branch.upstream o/main\n# branch.ab "


@pytest.mark.parametrize(
    ("code", "out", "status", "branch"),
    [
        (128, "", "no-git", ""), (0, f"{HEAD}{UP}+0 -0\n", "clean", "main"), (0, f"{HEAD}{UP}+0 -3\n", "clean", "main"), (0, f"{HEAD}{UP}+2 -0\n", "unpushed", "main"), (0, f"{HEAD}{UP}+10 -0\n1 .M N... a\n", "unpushed", "main"),
        (0, f"{HEAD}\n", "unpushed", "main"), (0, f"{HEAD}\n? new\n", "unpushed", "main"), (0, f"{HEAD}{UP}+0 -0\n? new file\n", "uncommitted", "main"), (0, f"{HEAD}{UP}+0 -0\n 1 x\n", "uncommitted", "main"),
        (0, "# branch.oid (initial)\n# branch.head main\n", "clean", "main"), (0, "# branch.oid (initial)\n# branch.head main\n? a\n", "uncommitted", "main"), (0, "# branch.oid 1a\n# branch.head (detached)\n", "clean", ""),
        (0, "# branch.oid 1a\n# branch.head (detached)\n1 .M N... a\n", "uncommitted", ""), (128, HEAD, "no-git", ""),
    ],
)
def test_repository_states(spark, code, out, status, branch):
    row = spark.createDataFrame([(code, out)], "c int, o string").select(text.git_status(F.col("c"), F.col("o")).alias("s"), text.branch_name(F.col("c"), F.col("o")).alias("b")).first()
    assert (row.s, row.b) == (status, branch)


def test_secret_paths(spark):
    cases = {
        ".env": "env", "a/.env.production": "env", ".envrc": "env", "x/.dev.vars": "env", ".env.example": None, ".env.sample": None, "b/.env.template": None, "k/a.pem": "key", "id_rsa": "key", "id_rsa.pub": None, "id_ed25519": "key", "keyboard": None,
        "x.keystore": "key", "credentials": "credentials", "c/credentials.json": "credentials", "client_secret_12.apps.json": "credentials", "service-account-prod.json": "credentials", "app-secrets.json": "credentials", "secrets.yaml": "credentials",
        "secrets.txt": None, ".npmrc": "tool", "h/.pgpass": "tool", ".my.cnf": "tool", "h/.aws/config": None, "h/.ssh/config": "tool", ".ssh/keys/a": "tool", "my.ssh/config": None, "p.tfvars": "infra", "t/x.tfstate": "infra", "x.tfstate.backup": "infra",
        "dist/main.js": None, "src/env.py": None, "secret/readme.md": None,
    }
    assert told(spark, text.secret_path, cases) == list(cases.values())


def test_first_lines(spark):
    cases = {
        "# Title\nmore": "Title", "\n  \n- item": "item", "12. twelfth": "twelfth", "* star": "star", "snake_case *it*": "snake_case *it*", "**bold** and __under__ `code`": "bold and under code", "> quote": "> quote", "+ plus": "+ plus",
        "1) one": "1) one", "#hash": "#hash", "   ### deep": "deep", "": "", " \n\t": "", "- - twice": "- twice", "\t# tab　": "tab",
    }
    assert told(spark, text.first_line, cases) == list(cases.values())


def test_widths(spark):
    cases = {"abc": 3, "日本": 4, "ｱ": 1, "Ａ": 2, "é": 1, "a‍b": 2, "‎": 1, "️": 0, "︎": 1, "〿": 2, "぀": 2, "\U0001f600": 2, "\U00020000": 1, "한": 2, "": 0}
    assert told(spark, text.display_width, cases) == list(cases.values())


def test_lines_of_reviews(spark):
    lines = ["10:x = 1", "diff --git a/m.py b/m.py", "--- a/m.py", "+++ b/m.py", "@@ -3,2 +7,3 @@ def f(a: int):", " a: 1", "-b", "+c 5:6", "+++ b", " d", "@@ -20 +30 @@", "+e", "src/n.py:44:+ f", "12:g", "+not a diff", "diff --git a/o b/o", "+before a hunk", "+++ b/o", "@@ -1 +1 @@", "+h"]
    rows = spark.createDataFrame([("k", i, x, "p.py") for i, x in enumerate(lines)], "key string, n int, line string, path string")
    assert [(r.n, r.file, r.line_no) for r in diffs.places(rows).orderBy("n").collect()] == [(0, "p.py", 10), (5, "m.py", 7), (7, "m.py", 8), (9, "m.py", 9), (11, "m.py", 30), (12, "src/n.py", 44), (13, "p.py", 12), (19, "o", 1)]


def test_scans_and_branches(spark):
    paths = ["/r/a.md", "/r/Library/a.md", "/r/dist/a.md", "/r/build/x/a.text", "/r/target/a.RST", "/r/vendor/a.markdown", "/r/a.csv", "/r/AppData/a.md", "/r/x/Applications/a.md", "/r/System/a.md", "/r/System.md", "/r/.x/a.md", "/r/venv/a.pdf"]
    kept = files.keep(spark.createDataFrame([(p,) for p in paths], "path string"), "/r")
    assert {r.path for r in kept.collect()} == {"/r/a.md", "/r/dist/a.md", "/r/build/x/a.text", "/r/target/a.RST", "/r/vendor/a.markdown", "/r/System.md"}
    assert len(files.EXCLUDED) == 8 and len(audit.PRUNED) == 36 and logs.TYPES == {"feature": "feat", "bug": "fix"}
    home = [f"/h/{d}/.tool/settings.json" for d in ("a", "Pictures", "go", "a/.tox", "dist", "goo", ".tool/worktrees/b", ".tool/other/b")]
    assert {r.path.split("/")[2] for r in audit.config_tree(spark.createDataFrame([(p,) for p in home], "path string"), "/h").collect()} == {"a", "goo", ".tool"}


def test_findings_of_keys_beyond_four_digits(spark, tmp_path):
    import duckdb

    import __spark_entry__ as e

    at = f"{tmp_path}/lineitem.parquet"
    duckdb.sql(f"COPY (SELECT l_orderkey, l_suppkey + i * 9996 AS l_suppkey, l_linenumber, l_returnflag, l_linestatus FROM '/root/testdata/sf0.001/lineitem.parquet', range(7) r(i) WHERE l_suppkey < 9) TO '{at}'")
    with duckdb.connect() as c:
        c.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{at}'")
        for name in ("findings_grouped", "findings_nested", "findings_ordered"):
            own = e.queries()[name](spark, str(tmp_path))
            told = c.execute(f"SELECT {', '.join(own.columns)} FROM ({e.oracle_sql()[name]})").fetchall()
            assert sorted(map(str, told)) == sorted(str(tuple(r)) for r in own.collect()), name


def test_main_words_keep_references_without_semicolon(spark, tmp_path):
    import hashlib

    import __spark_entry__ as e

    page = "<html><body><article><h1>up &amp; down&amp</h1><p>" + "many words of a page that says much, " * 9 + "&lt;b&gt;</p></article></body></html>"
    spark.createDataFrame([(1, "u", page)], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    words = ("up & down&amp " + "many words of a page that says much, " * 9 + "<b>").split()
    assert [tuple(r) for r in e.queries()["page_main_words"](spark, str(tmp_path)).collect()] == [(1, len(words), hashlib.sha256(" ".join(words).encode()).hexdigest())]


def test_short_texts_out_of_bytes():
    from lodestream.sources.documents import decode_text

    for name, text in (("utf-16-le", "H"), ("utf-16-be", "H"), ("utf-8", ""), ("cp1251", "Hello world Привет"), ("koi8_r", "Хорошая погода")):
        assert decode_text(text.encode(name)) == text, (name, text)


def test_bytes_are_read_in_bounded_batches(spark):
    import __spark_entry__ as e

    plan = e.queries()["charset_shares"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "ArrowEvalPython" not in plan


@pytest.mark.parametrize("name", ["diff_line_numbers", "review_line_numbers"])
def test_line_numbers_sort_once(spark, name):
    plan = rules.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Sort [") == 1 and plan.count("Exchange ") == 1 and "Aggregate" not in plan


def test_backup_is_a_second_name_and_replaces_an_older_one(tmp_path):
    from lodestream.sources.writeback import BACKUP, Written, _Writer

    path = str(tmp_path / "a" / "s.json")
    before = None
    for text in ("one", "two", "three"):
        w = _Writer(str(tmp_path), False)
        new = f"{w.stage}/x"
        with open(new, "w") as f:
            f.write(text)
        w.commit([Written([(path, new)])])
        with open(path) as f:
            assert f.read() == text
        if text == "two":
            assert os.stat(path + BACKUP).st_ino == before
        before = os.stat(path).st_ino
    with open(path + BACKUP) as f:
        assert f.read() == "two"
    assert sorted(os.listdir(tmp_path)) == ["a"] and sorted(os.listdir(tmp_path / "a")) == ["s.json", "s.json" + BACKUP]


def test_accented_words_among_latin_ones_are_no_other_script():
    from lodestream.sources.documents import decode_text

    for text in ("Oi on èê, le", "ich öü " * 40 + "und", "ege ää sts ist das", "der üöö enb und ö, de", "una óí. " * 30 + "ciónes jagañ", "eleoi èèé " * 60 + "Équer treêê êieroi", "ter ßö ßö ßö"):
        assert decode_text(text.encode("cp1252")) == text, text
    for name, text in (("cp1251", "Hello кот"), ("cp1251", "Plain words and more words, then Привет and no more"), ("koi8_r", "Good weather: Хорошая погода"), ("cp932", "Hello 検索"), ("cp1251", "Я не знаю")):
        assert decode_text(text.encode(name)) == text, (name, text)
