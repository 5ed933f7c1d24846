import sqlite3

from lodestream.functions import chunking, dom, html, markdown
from lodestream.operators import lexical
from lodestream.sources import documents
from lodestream.streaming import state


def test_chunks_cover_lines_and_carry_overlap():
    lines = [f"line {i} " + "x" * 90 for i in range(30)]
    c = chunking.chunk_lines(lines)
    assert c[0][1] == 1 and c[-1][2] == 30 and [x[0] for x in c] == list(range(len(c)))
    assert all(b[1] <= a[2] for a, b in zip(c, c[1:], strict=False))


def test_short_section_repeats_after_heading():
    c = chunking.chunk_lines(["# a", "one", "# b", "y" * 200])
    assert c[0] == (0, 1, 2, "# a\none") and c[1][1] == 1


def test_oversize_line_has_no_overlap_and_tail_merges():
    c = chunking.chunk_lines(["z" * 4500, "end"])
    assert [len(x[3]) for x in c[:2]] == [2000, 2000] and c[2][3].endswith("\nend") and c[2][1:3] == (1, 2)
    assert chunking.chunk_lines(["", " "]) == []


def test_message_parts():
    parts = markdown.split_message("hi\r\n\r\n```py\nx\n```\n| a | b |\n|---|:-:|\n| 1 | 2\\|3 |\n\nbye")
    assert [(k, t) for _, k, t in parts] == [("plain", "hi"), ("code", "x"), ("table", "| a | b |\n|---|:-:|\n| 1 | 2\\|3 |"), ("plain", "bye")]
    assert markdown.split_message("```\n```")[0][1] == "plain"
    assert markdown.split_row("| a\\|b | c |") == ["a\\|b", "c"]


def test_html_main_content_drops_navigation():
    page = "<html><nav>menu</nav><article><h2>T</h2><p>a <b>b</b></p><script>x</script></article><footer>f</footer></html>"
    assert html.to_markdown(page, True) == "## T\n\na **b**"
    assert "menu" in html.to_markdown(page) and html.to_markdown("") == "" and html.to_markdown("", True) == html.EMPTY


LONG = "It was a long way to the harbour, and the road, which had been mended in spring, was wet again."
PAGES = {
    "scored": f"<body><div id=nav><ul><li><a href=/>home</a><li><a href=/n>news</a></ul></div><div><div><p>{LONG}</p><p>Short.</p><p>{LONG}</p></div></div><div><a href=/x>{LONG}</a></div></body>",
    "named": f"<div class='sidebar'><p>{LONG}</p><p>{LONG}</p><p>{LONG}</p></div><div class='post-content'><p>{LONG}</p><p>Short.</p><p>{LONG}</p></div>",
    "siblings": f"<div><p>{LONG}</p><p>Short.</p></div><div><p>{LONG}</p></div><div><a href=/>a</a> <a href=/b>b</a></div>",
    "header": f"<header><p>{LONG}</p></header><article><p>{LONG}</p><p>Short.</p><p>{LONG}</p><form>{LONG}</form></article>",
    "deep": "<div>" * 3000 + f"<p>{LONG}</p><p>Short.</p><p>{LONG}</p>",
}


def test_main_content_by_scores():
    want = f"{LONG} Short. {LONG}"
    for name, page in PAGES.items():
        assert dom.main_text(page) == want, name
    assert dom.main_text("<p>tiny</p>") == "tiny" and dom.main_text(None) == dom.main_text("<nav>x</nav>") == ""
    # Scores rise: whole to the parent, by half to the next, then by a third of the level.
    tree = dom.pruned(dom.parse(f"<section><div><div><p>{LONG}</p></div></div></section>"))
    held = {n.tag + str(i): s for i, (n, s) in enumerate(dom.scores(tree).items())}
    points = 1 + LONG.count(",") + len(LONG) // 100
    assert list(held.values()) == [points, points / 2, points / 6, points / 9]


def test_markdown_of_trees():
    page = "<h2>T <i>x</i></h2><p>a <b>b</b><br>c <a href=u>l</a> <code>z</code><img src=s alt=t></p><ul><li>one<li>two<ol start=3><li>in</ol></ul><blockquote><p>q1<p>q2</blockquote><pre>a  b\n c</pre><table><tr><th>h|1<th>h2<tr><td>1</table><hr>"
    assert html.to_markdown(page) == "## T *x*\n\na **b**  \nc [l](u) `z`![t](s)\n\n* one\n* two\n  3. in\n\n> q1\n>\n> q2\n\n```\na  b\n c\n```\n\n| h\\|1 | h2 |\n| --- | --- |\n| 1 |  |\n\n---"


def test_charsets_by_disorder():
    for name, s in (("cp932", "検索エンジンの設計と評価"), ("euc_jp", "検索エンジンの設計"), ("euc_kr", "안녕하세요 한국어 문장입니다"), ("gb18030", "你好，世界。这是中文的句子"), ("big5", "你好，這是繁體中文的句子"), ("cp1251", "Привет, это русский текст"), ("koi8_r", "Привет, это русский текст"), ("cp1252", "Le café déjà là, “bien sûr”"), ("mac_roman", "Äpfel und größere Bäume"), ("utf-16-be", "plain text")):
        assert documents.decode_text(s.encode(name)) == s, name
    assert documents.decode_text("été".encode("utf-16")) == "été" and documents.decode_text(None) == ""


def test_decoding():
    assert documents.decode_text("検索".encode("cp932")) == "検索" and documents.decode_text(b"") == "" and documents.office_text(b"bad", ".docx") is None


def test_state_handlers():
    s, r = state.refresh(None, 0, "a")
    assert r == "reset" and state.refresh(s, 10, "a")[1] == "wait" and state.refresh(s, 300, "a:error")[0][1] == 360
    assert state.reload(("loading",), 1, "start")[1] == "loading" and state.expire((5,), 6, "tick")[1] == "idle"


def test_bm25_agrees_with_sqlite(spark):
    texts = ["banana ananas", "an ana", "nothing here", "banana bread banana", "plain words only", "more filler text", "tail of it"]
    con = sqlite3.connect(":memory:")
    con.execute("CREATE VIRTUAL TABLE f USING fts5(t, tokenize='trigram')")
    con.executemany("INSERT INTO f(rowid, t) VALUES (?, ?)", list(enumerate(texts, 1)))
    df = spark.createDataFrame(list(enumerate(texts, 1)), "chunk_id long, text string")
    for terms in (["ana"], ["banana"], ["banana", "bread"]):
        match = " AND ".join('"' + t.replace('"', '""') + '"' for t in terms)
        want = dict(con.execute("SELECT rowid, bm25(f) FROM f WHERE f MATCH ?", (match,)).fetchall())
        got = {r.chunk_id: r.bm25 for r in lexical.bm25(df, terms, True).collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_stream_state(spark, tmp_path):
    rows = [("r", 0, "start"), ("r", 1, "ok"), ("r", 2, "tick")]
    spark.createDataFrame(rows, "key string, ts long, event string").write.json(str(tmp_path / "in"))
    events = spark.readStream.schema("key string, ts long, event string").json(str(tmp_path / "in"))
    q = state.run_stream(events, state.reload, "name string").writeStream.format("memory").queryName("reloads").outputMode("append").trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    assert [r.result for r in spark.sql("SELECT result FROM reloads ORDER BY ts").collect()] == ["loading", "done", "idle"]
