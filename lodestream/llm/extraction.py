"""Main text of web pages: streaming parser events, text-to-tag ratios, Gaussian smoothing, threshold clustering.

The standard library's parser gives events; they make lines (a block's text between block borders, with
its letters, tags and letters in links) and a thin tree of the elements around them. A line's ratio is
its letters by its tags. The ratios, smoothed by a Gaussian, fall into two clusters at the threshold
that parts them best; the upper cluster's lines are the seeds of content. Content is the element that
holds the seeds: an article or main element with half of their letters, or else the deepest element
with nine tenths of them, without what stands outside the seeds there but for headings. Inside it
every line stays, short ones too, but for those in menus, headers and footers of the page, sidebars,
notices, adverts, forms, reader comments and hidden parts, which are told by element, role and the
words of class and id (a part that holds the article itself is none of these).

Defined results: null, empty and markup-only pages give an empty text; a page without any tag is one
block; broken markup (unclosed or crossing elements, a page cut within a tag or comment) is read like a
browser reads it; pages are taken whole; rows that repeat stay; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header "
    "hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead title tr ul".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
#: Elements whose text is never the article's.
DROPPED = frozenset(
    "aside audio button canvas datalist dialog embed form footer head iframe input menu meter nav noembed noframes noscript object option progress script search select style svg template textarea title video".split()
)
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search searchbox status tablist toolbar tooltip".split())
#: Words of a class or id that tell what is no content wherever they stand.
SAYS = frozenset(
    "ad ads adsbygoogle adbox adsense adslot advert adverts advertisement advertising advertisements adv breadcrumb breadcrumbs consent cookie cookies copyright "
    "footer gdpr login masthead menu menus modal nav navbar navigation navi newsletter notice notices notification offcanvas overlay pager pagination paywall popup popups promo promos "
    "promoted promotion promotions recommended recommendations related rail share sharing shares sidebar sidebars signup sitenav skip social sponsor sponsored sponsors "
    "subscribe subscription subnav teaser teasers toolbar topbar trending widget widgets".split()
)
#: Words that tell readers' comments.
COMMENTS = frozenset("comment commenter commenters commentlist comments disqus disqussion guestbook replies reply respond".split())
#: Words that tell the same unless the element is said to be the article's own.
WEAK = frozenset("alert banner header search site side".split())
OWN = frozenset("article body content entry main post story text".split())
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_PAIRS = frozenset({("side", "bar"), ("read", "more"), ("see", "also")})
#: An opening element closes open ones of these kinds, up to the nearest of the borders.
_CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"table", "tr"}),
    "th": ({"td", "th"}, {"table", "tr"}), "tbody": ({"tr", "td", "th", "thead", "tbody", "caption"}, {"table"}), "tfoot": ({"tr", "td", "th", "thead", "tbody", "caption"}, {"table"}),
    "option": ({"option"}, {"select"}), "optgroup": ({"option", "optgroup"}, {"select"}), "body": ({"head"}, {"html"}),
}
_HEAD = frozenset("base basefont bgsound link meta noscript script style template title head html".split())


#: Browsers nest no deeper; what is deeper counts as beside its parent.
DEEPEST = 512


def _says(words: list[str], tag: str) -> int:
    """What the words of class and id tell: 1 reader comments, 2 another part that is no content, 0 nothing of the kind."""
    # "has-sidebar" and "no-comments" speak of other parts.
    words = [w for before, w in zip(["", *words], words, strict=False) if before not in ("has", "no", "with", "without")]
    if any(w in COMMENTS for w in words):
        return 1
    if tag == "article" and any(w in OWN for w in words):
        return 0
    if any(w in SAYS for w in words) or any(p in _PAIRS for p in zip(words, words[1:], strict=False)):
        return 2
    return 2 * (tag not in HEADINGS and any(w in WEAK for w in words) and not any(w in OWN for w in words))


class Page(HTMLParser):
    """Lines and elements of one page.

    Elements: parent, tag, whether an article or main, and drop (0 content, 1 never content, 2 no content
    unless it holds the article). Lines: element, text, letters in links, tags.
    """

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.parent, self.tag, self.main, self.drop = [-1], ["#"], [False], [0]
        self.stack, self.lines, self.parts, self.at = [0], [], [], 0
        self.tags = self.linked = self.links = self.hushed = 0
        self.ended = False
        self.feed(html)
        self.ended = True
        self.close()
        self._line()

    # Markup that the page's end cuts off is no text.
    def parse_starttag(self, i):
        return self._cut_off(super().parse_starttag(i))

    def parse_endtag(self, i):
        return self._cut_off(super().parse_endtag(i))

    def parse_pi(self, i):
        return self._cut_off(super().parse_pi(i))

    def parse_comment(self, i, report=1):
        for short in (">", "->"):
            if self.rawdata.startswith(short, i + 4):
                return i + 4 + len(short)
        ends = [(k + len(end)) for end in ("-->", "--!>") if (k := self.rawdata.find(end, i + 4)) >= 0]
        return min(ends) if ends else self._cut_off(-1)

    def parse_html_declaration(self, i):
        if self.rawdata.startswith("<!--", i):
            return self.parse_comment(i)
        k = self.rawdata.find(">", i)
        return k + 1 if k >= 0 else self._cut_off(-1)

    def _cut_off(self, k: int) -> int:
        return len(self.rawdata) if k < 0 and self.ended else k

    def _line(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            self.lines.append((self.at, text, min(self.linked, len(text)), self.tags))
            self.tags = 0
        self.parts.clear()
        self.linked = 0

    def _pop_to(self, depth: int) -> None:
        gone = self.stack[depth:]
        if any(self.tag[e] in BLOCKS for e in gone):
            self._line()
        del self.stack[depth:]
        for e in gone:
            self.links -= self.tag[e] == "a"
            self.hushed -= self.tag[e] not in BLOCKS and self.drop[e] > 0
        if self.at in gone:
            self.at = next(e for e in reversed(self.stack) if not e or self.tag[e] in BLOCKS)

    def _close(self, tags, borders) -> None:
        """Closes the open elements of the given kinds, outward to the nearest border."""
        lowest = None
        for depth in range(len(self.stack) - 1, 0, -1):
            tag = self.tag[self.stack[depth]]
            if tag in borders:
                break
            if tag in tags:
                lowest = depth
        if lowest is not None:
            self._pop_to(lowest)

    def _dropped(self, tag: str, attrs) -> int:
        if tag in DROPPED:
            return 2 if tag == "form" else 1
        words = []
        for name, value in attrs:
            value = value or ""
            if name == "role" and value.strip().lower() in ROLES or name == "hidden" or name == "aria-hidden" and value.lower() == "true":
                return 1
            if name == "style" and "display:none" in value.replace(" ", "").lower():
                return 1
            if name in ("class", "id"):
                words += [w.lower() for w in _WORDS.findall(value)]
        inside = any(self.main[e] for e in self.stack)
        if tag == "article" and any(self.tag[e] == "article" for e in self.stack):
            return 1  # an article within another is a reader's comment or a teaser
        if tag == "header" and not inside:
            return 2
        return _says(words, tag) if words and tag not in ("html", "body", "main") else 0

    def handle_starttag(self, tag, attrs):
        if tag in BLOCKS:
            self._line()
            for depth in range(len(self.stack) - 1, 0, -1):
                if self.tag[self.stack[depth]] in BLOCKS:
                    # A block ends an open paragraph.
                    if self.tag[self.stack[depth]] == "p":
                        self._pop_to(depth)
                    break
        elif tag == "br":
            self.parts.append(" ")
        self.tags += 1
        if tag in _CLOSES:
            self._close(*_CLOSES[tag])
        elif tag not in _HEAD:
            for depth, e in enumerate(self.stack[:4]):
                if self.tag[e] == "head":
                    self._pop_to(depth)
                    break
        if tag in VOID:
            return
        if len(self.stack) > DEEPEST:
            self._pop_to(len(self.stack) - 1)
        drop = self._dropped(tag, attrs)
        main = not drop and (tag in ("article", "main") or ("role", "main") in attrs or ("role", "article") in attrs)
        if main:
            for e in self.stack:
                if self.drop[e] == 2:
                    self.drop[e] = 0
        self.parent.append(self.at)
        self.tag.append(tag)
        self.main.append(main)
        self.drop.append(drop)
        self.stack.append(len(self.tag) - 1)
        if tag in BLOCKS:
            self.at = self.stack[-1]
        else:
            self.links += tag == "a"
            self.hushed += drop > 0

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        # Only foreign elements close themselves; as no text can tell, all inline ones do here.
        if tag not in VOID and tag not in BLOCKS:
            self._pop_to(len(self.stack) - 1)

    def handle_endtag(self, tag):
        self.tags += 1
        for depth in range(len(self.stack) - 1, 0, -1):
            open_ = self.tag[self.stack[depth]]
            if open_ == tag:
                self._pop_to(depth)
                return
            if tag not in BLOCKS and open_ in BLOCKS:
                return
        if tag in BLOCKS or tag == "br":
            self._line()

    def handle_data(self, data):
        if not self.hushed:
            self.parts.append(data)
            if self.links:
                self.linked += len(data.strip())


def smooth(ratios: np.ndarray, sigma: float = 1.0) -> np.ndarray:
    """Convolution with a Gaussian; the ends count what is there."""
    reach = int(np.ceil(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    n = len(ratios)
    return np.convolve(ratios, kernel)[reach : reach + n] / np.convolve(np.ones(n), kernel)[reach : reach + n]


def threshold(values: np.ndarray) -> float:
    """The value that parts the values into two clusters with the least squares inside; the smallest if all are alike."""
    v = np.sort(values)
    n = np.arange(1, len(v))
    if not len(n) or v[0] == v[-1]:
        return float(v[0])
    total = np.cumsum(v)
    left = total[:-1]
    between = left**2 / n + (total[-1] - left) ** 2 / (len(v) - n)
    # Equal values fall into one cluster.
    between[v[1:] == v[:-1]] = -1
    return float(v[int(np.argmax(between)) + 1])


#: Elements that can be the content as a whole.
CONTAINERS = frozenset("# article body center div form html main section td".split())


def _below(parent: list[int], weight: np.ndarray) -> np.ndarray:
    """Each element's weight with all that is inside it."""
    out = weight.tolist()
    for e in range(len(parent) - 1, 0, -1):
        out[parent[e]] += out[e]
    return np.array(out)


def content(page: Page) -> list[str]:
    """The lines of the main text, in page order."""
    if not page.lines:
        return []
    at, letters = np.array([x[0] for x in page.lines]), np.array([len(x[1]) for x in page.lines], float)
    linked, tags = np.array([x[2] for x in page.lines], float), np.array([x[3] for x in page.lines], float)
    count, drop, parent = len(page.tag), np.array(page.drop), page.parent

    out = drop > 0
    if not any(page.main):
        # Most of a page is not in its margins: there, a part with most of its letters is none.
        never = drop == 1
        for e in range(1, count):
            never[e] |= never[parent[e]]
        sums = _below(parent, np.bincount(at, letters * ~never[at], count))
        out &= never | (2 * sums <= sums[0])
    home = [0] * count
    for e in range(1, count):
        out[e] |= out[parent[e]]
        home[e] = e if page.tag[e] in CONTAINERS else home[parent[e]]
    open_ = ~out[at]
    if not open_.any():
        return []

    ratio = np.where(open_, (letters - linked) / np.maximum(tags, 1), 0.0)
    smoothed = smooth(ratio)
    seeds = open_ & (smoothed >= threshold(smoothed))
    if not (seeds & (letters > linked)).any():
        seeds = open_
    held = _below(parent, np.bincount(at, np.where(seeds, np.maximum(letters - linked, 1), 0), count))
    told = [e for e in range(count) if page.main[e] and not out[e] and 2 * held[e] >= held[0]]
    root = told[-1] if told else max(e for e in range(count) if page.tag[e] in CONTAINERS and not out[e] and 10 * held[e] >= 9 * held[0])
    within = np.zeros(count, bool)
    within[root] = True
    for e in range(root + 1, count):
        within[e] = within[parent[e]]
    keep = open_ & within[at]
    if not told:
        homes = np.array(home)[at]
        first, *_, last = [*np.flatnonzero(seeds & keep), *np.flatnonzero(seeds & keep)[-1:]]
        place = np.arange(len(at))
        heading = np.array([page.tag[e] in HEADINGS for e in at])
        edge = (place < first) | (place > last)
        menu = 2 * linked > letters
        keep &= ~menu & (~edge | np.isin(homes, homes[seeds & keep]) | (heading & (place < first)))
    return [page.lines[i][1] for i in np.flatnonzero(keep)]


def main_text(html: str | None) -> str:
    return "\n\n".join(content(Page(html))) if html else ""


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url and text for every row."""

    def run(batches):
        for batch in batches:
            for part in common.small_batches([batch], 500):
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([main_text(h) for h in part.column(2).to_pylist()], pa.string())], ["page_id", "url", "text"])

    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    kinds = dict(rows.dtypes)
    return common.map_arrow(rows, run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string")


def op13_extraction(spark, sf_dir: str) -> DataFrame:
    return extract(common.spread(common.table(spark, sf_dir, "pages"))).withColumn("n_chars", F.length("text").cast("long"))
