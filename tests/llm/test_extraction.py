"""Main text of pages: the given pages against their articles, and layouts and odd markup by hand."""

import html
import random
import re

import numpy as np
import pytest

from lodestream.llm import extraction

DIR = "/root/testdata/sf0.01"
P = [
    "The harbour was rebuilt after the storm of 1953, when most of the old quay had gone under water.",
    "Short one.",
    "Fishing boats came back within a year & trade with the islands began again, slowly at first.",
    "It is now a museum, open on weekdays, with a small library on the history of the coast.",
]
BODY = "\n\n".join(P)
PARAGRAPHS = "".join(f"<p>{html.escape(p)}</p>" for p in P)
MENU = "<ul>" + "".join(f'<li><a href="/{w}">{w}</a></li>' for w in "Home News Sport Weather Contact".split()) + "</ul>"
LONG = "We and our partners use cookies to store and read data on your device, for which we ask your consent, as the law demands it of us."
JUNK = f'<script>var a = "<p>no</p>"; if (a < b) c();</script><style>p {{ margin: 0 }}</style><!-- note <p>no</p> -->'


def test_articles_of_the_given_pages(spark):
    rows = extraction.op13_extraction(spark, DIR).collect()
    pages = {r.page_id: r for r in spark.read.parquet(f"{DIR}/pages.parquet").collect()}
    assert len(rows) == len(pages)
    for r in rows:
        inside = re.search(r"<article>(.*?)(</article>|$)", pages[r.page_id].html, re.S).group(1)
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]+>", "", x)).split()) for x in re.split(r"</?(?:p|h1|br)\b[^>]*>", inside)]
        assert r.text == "\n\n".join(b for b in blocks if b) and r.url == pages[r.page_id].url and r.n_chars == len(r.text)


LAYOUTS = {
    "article": f"<html><head><title>T</title>{JUNK}</head><body><header><h1>Site</h1>{MENU}</header><article>{PARAGRAPHS}</article><footer><p>{LONG}</p></footer></body></html>",
    "main": f"<body><nav>{MENU}</nav><div class='cookie-banner'><p>{LONG}</p></div><main class='with-sidebar'>{PARAGRAPHS}<aside><p>{LONG}</p></aside></main></body>",
    "role": f"<div role=banner>{LONG}</div><div role=main>{PARAGRAPHS}<div role='complementary'>{LONG}</div></div><div role=contentinfo>{LONG}</div>",
    "divs": f"<body><div id=top>{MENU}</div><div id='content'><div class=inner>{PARAGRAPHS}</div></div><div id='sidebar'>{MENU}<p>{LONG}</p></div><div class='site-footer'>{LONG}</div></body>",
    "no names": f"<body><div>{MENU}</div><div>{PARAGRAPHS}</div><div>{MENU}</div></body>",
    "comments": f"<article>{PARAGRAPHS}<section id=comments><h2>Comments</h2><article><p>{LONG}</p></article><div class=c>{LONG * 9}</div></section></article>",
    "nested comments": f"<article>{PARAGRAPHS}<article><p>{LONG}</p></article></article>",
    "reader": f"<main><article>{PARAGRAPHS}</article><div class='user-comments'><p>{LONG * 5}</p></div></main>",
    "advert in the text": f"<article><p>{P[0]}</p><div class='ad-slot'>{LONG}</div><p>{P[1]}</p><p>{html.escape(P[2])} <span class=ad>Buy!</span></p><p>{P[3]}</p></article>",
    "form around all": f"<body><form id=aspnetForm><div id=nav>{MENU}</div><div id=text>{PARAGRAPHS}</div><input value=x><select><option>one<option>two</select></form></body>",
    "form in the text": f"<article>{PARAGRAPHS}<form><label>Name</label><input><textarea>{LONG}</textarea><button>Send</button></form></article>",
    "table": f"<table><tr><td>{MENU}<td>{PARAGRAPHS}</table>",
    "unclosed": f"<article><p><b>{P[0]}<p>{P[1]}<p><i>{html.escape(P[2])}<br><p>{P[3]}",
    "crossing": f"<div class=nav><b>{MENU}</div></b><article>{PARAGRAPHS}</article></div></div>",
    "cut in a tag": f'<article>{PARAGRAPHS}</article><footer class="x',
    "cut in a comment": f"<article>{PARAGRAPHS}</article><!-- <p>{LONG}</p>",
    "cut in a script": f"<article>{PARAGRAPHS}</article><script>var x = '<p>{LONG}</p>'",
    "hidden": f"<article><p hidden>{LONG}</p><div style='display: none'>{LONG}</div><p aria-hidden=true>{LONG}</p>{PARAGRAPHS}</article>",
    "said to be one": f"<div class='post no-sidebar'><div class=entry-content>{PARAGRAPHS}</div><div class='entry-share'>{LONG}</div></div>",
    "wrapper with a bad name": f"<body><div class='page sidebar-layout'><div>{PARAGRAPHS}</div></div></body>",
    "classes of a post": f"<article class='post tag-social category-news'>{PARAGRAPHS}</article>",
    "declarations": f"<?xml version='1.0'?><!DOCTYPE html><![CDATA[ x ]]><![foo bar><!><!--><article>{PARAGRAPHS}</article><!-- a --!>",
    "upper case": f"<BODY><NAV>{MENU}</NAV><ARTICLE>{PARAGRAPHS.replace('<p>', '<P>')}</ARTICLE></BODY>",
    "self-closing": f"<article><script src=x /><i/>{PARAGRAPHS}<br/></article>",
}


@pytest.mark.parametrize("name", LAYOUTS)
def test_layout(name):
    assert extraction.main_text(LAYOUTS[name]) == BODY


def test_blocks_and_references():
    page = "<article><h1>A&nbsp;&amp;amp; B</h1>\n<p>one\n  two<br>three &lt;b&gt; &#233;&#x1F600;<ul><li>x<li>y <i>z</i>w</ul><blockquote>q</blockquote>t</article>"
    assert extraction.main_text(page) == "A &amp; B\n\none two three <b> é\U0001f600\n\nx\n\ny zw\n\nq\n\nt"
    assert [extraction.main_text(x) for x in (None, "", "  ", "<p></p>", "plain  text", "<br>", "a < b & c")] == ["", "", "", "", "plain text", "", "a < b & c"]


def test_header_of_the_article_stays():
    assert extraction.main_text(f"<header>Site</header><article><header><h1>Title</h1></header>{PARAGRAPHS}<footer>By me</footer></article>") == "Title\n\n" + BODY


def test_threshold_and_smoothing_match_brute_force():
    rnd = np.random.default_rng(5)
    for _ in range(200):
        v = rnd.integers(0, 12, rnd.integers(1, 15)).astype(float)
        t = extraction.threshold(v)
        spread = lambda c: sum(((x - x.mean()) ** 2).sum() for x in (v[v >= c], v[v < c]) if len(x))  # noqa: E731, B023
        cuts = [c for c in set(v.tolist()) if c > v.min()] or [v.min()]
        assert t in cuts and spread(t) <= min(spread(c) for c in cuts) + 1e-9
        kernel = np.exp(-0.5 * np.arange(-3, 4) ** 2)
        slow = [sum(kernel[3 + j - i] * v[j] for j in range(len(v)) if abs(j - i) <= 3) / sum(kernel[3 + j - i] for j in range(len(v)) if abs(j - i) <= 3) for i in range(len(v))]
        assert np.allclose(extraction.smooth(v), slow)


def test_any_markup_is_read():
    rnd = random.Random(3)
    pieces = ["<p>", "</p>", "<b", "<div class='ad'>", "</div>", "<!--", "-->", "<![x", "<a href=", ">", "text &amp", "&#;", "<article>", "</article>", "<script>", "</script>", "<li>", "</", "<td>", "\x00", "<option>", "<form>", "'", '"', "<h1>", "<?", "<svg/>"]
    for _ in range(3000):
        extraction.main_text("".join(rnd.choice(pieces) for _ in range(rnd.randint(0, 30))))


def test_deep_and_long_pages():
    nested = BODY.replace("\n\n", "<p>").replace("&", "&amp;")
    assert extraction.main_text("<div>" * 400 + nested + "</div>" * 400) == BODY
    assert extraction.main_text("<div>" * 50_000 + nested + "</div>" * 50_000).endswith(P[3])
    assert extraction.main_text("<b>" * 50_000 + "x" + "</i>" * 50_000 + "</b>" * 50_000) == "x"
    words = "word " * 400_000
    assert extraction.main_text(f"<article><p>{words}</article>") == words.strip()


def test_odd_tables(spark):
    rows = [(None, "u", None, "a"), (1, None, "", "b"), (2, "v", LAYOUTS["article"], "c"), (2, "v", LAYOUTS["article"], "c")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    assert sorted((r.page_id or 0, r.url, r.text) for r in extraction.extract(df).where("url is not null").collect()) == [(0, "u", ""), (2, "v", BODY), (2, "v", BODY)]
    assert extraction.extract(df).count() == 4 and extraction.extract(df.where("false")).count() == 0
