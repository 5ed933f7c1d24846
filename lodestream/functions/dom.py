"""Pages as trees: the element with the main content by scores that rise, and trees as Markdown.

A paragraph scores by its length and its commas; its score goes to its parent whole, to the parent of
that by half, and to elements further out by ever smaller shares. Elements that are said to be the
article, or that are named like one, begin with a bonus, those named like margins with a loss; a share
of letters in links takes the same share away. The element with the highest score is the content,
with those beside it that score a fifth of it. Where next to nothing comes of that, the whole body
does, without what is no text of the page.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements without text of their own, and elements outside any main content.
SILENT = frozenset("script style noscript template svg head title iframe canvas object".split())
MARGIN = frozenset("nav footer aside form button select textarea dialog menu".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
HEADING = re.compile("h[1-6]")
#: What may be open when an element begins that closes it, up to the first of the borders.
ENDS = {"li": ("li", "ul ol menu"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr td th", "table"), "td": ("td th", "tr table"), "th": ("td th", "tr table"), "option": ("option", "select")}
#: Deeper elements count as beside their parent.
DEEPEST = 250
_GOOD = re.compile(r"(?i)\b(article|body|content|entry|main|page|post|story|text)\b")
_BAD = re.compile(r"(?i)\b(ads?|advert\w*|banner|breadcrumbs?|comments?|cookies?|footer|header|masthead|menu|nav\w*|promo\w*|related|share|sidebar|social|sponsor\w*|widget)\b")
#: Letters of a paragraph that scores, of the content below which the body is taken, the share of the best that a sibling needs, and its least score.
LEAST, SHORT, NEAR, FEW = 25, 60, 0.2, 3.0


class Node:
    __slots__ = ("attrs", "children", "parent", "tag")

    def __init__(self, tag: str, attrs: dict, parent: Node | None):
        self.tag, self.attrs, self.parent, self.children = tag, attrs, parent, []

    def elements(self):
        """All elements below, in page order."""
        stack = [iter(self.children)]
        while stack:
            for c in stack[-1]:
                if isinstance(c, Node):
                    yield c
                    stack.append(iter(c.children))
                    break
            else:
                stack.pop()

    def text(self) -> str:
        out = []
        stack = list(reversed(self.children))
        while stack:
            c = stack.pop()
            if isinstance(c, str):
                out.append(c)
            else:
                out.append(" " if c.tag in BLOCK or c.tag == "br" else "")
                stack += [" " if c.tag in BLOCK else "", *reversed(c.children)]
        return " ".join("".join(out).split())


class _Parser(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("#", {}, None)
        self.depth = 0

    def _close(self, tags, borders=()) -> bool:
        node, found = self.at, None
        while node.parent is not None and node.tag not in borders:
            if node.tag in tags:
                found = node
                if not borders or len(tags) == 1:
                    break
            node = node.parent
        while found is not None and self.at is not found.parent:
            self.at, self.depth = self.at.parent, self.depth - 1
        return found is not None

    def handle_starttag(self, tag, attrs):
        if tag in BLOCK:
            self._close(("p",), BLOCK - {"p"})
        if tag in ENDS:
            tags, borders = (x.split() for x in ENDS[tag])
            self._close(tags, borders)
        node = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(node)
        if tag not in VOID and self.depth < DEEPEST:
            self.at, self.depth = node, self.depth + 1

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag not in BLOCK and self.at.tag == tag:
            self.at, self.depth = self.at.parent, self.depth - 1

    def handle_endtag(self, tag):
        self._close((tag,), () if tag in BLOCK else BLOCK)

    def handle_data(self, data):
        self.at.children.append(data)

    def unknown_decl(self, data):
        pass


def parse(html: str | None) -> Node:
    p = _Parser()
    # Declarations in brackets are comments in a page.
    p.feed(re.sub(r"<!\[[^>]*>", "", html or ""))
    p.close()
    return p.root


def _named(node: Node, pattern: re.Pattern) -> bool:
    return pattern.search(f"{node.attrs.get('class', '')} {node.attrs.get('id', '')}".replace("-", " ").replace("_", " ")) is not None


def _inside(node: Node, *tags: str) -> bool:
    while node.parent is not None:
        node = node.parent
        if node.tag in tags:
            return True
    return False


def pruned(root: Node) -> Node:
    """The tree without scripts, menus, forms and margins; a header goes only outside an article."""
    stack = [root]
    while stack:
        node = stack.pop()
        kept = []
        for c in node.children:
            if isinstance(c, Node):
                margin = c.tag in SILENT or c.tag in MARGIN or (c.tag == "header" and not _inside(c, "article", "main"))
                named = c.tag in ("div", "section", "ul", "ol", "p", "span", "table") and _named(c, _BAD) and not _named(c, _GOOD)
                if margin or "hidden" in c.attrs or (named and not any(e.tag in ("article", "main") for e in c.elements())):
                    continue
                stack.append(c)
            kept.append(c)
        node.children = kept
    return root


def scores(root: Node) -> dict[Node, float]:
    """Every candidate's score, without the share of its letters in links."""
    out: dict[Node, float] = {}
    for node in root.elements():
        blocks = any(isinstance(c, Node) and c.tag in BLOCK for c in node.children)
        if node.tag not in ("p", "pre", "blockquote", "td", "li", "div", "section", "article", "main") or blocks:
            continue
        text = node.text()
        if len(text) < LEAST:
            continue
        points, above, level = 1 + text.count(",") + min(len(text) // 100, 3), node.parent, 0
        while above is not None and level < 5:
            share = 1 if level == 0 else 0.5 if level == 1 else 1 / (3 * level)
            out[above] = out.get(above, 0.0) + points * share
            above, level = above.parent, level + 1
        if node.tag in ("div", "section", "article", "main"):
            out[node] = out.get(node, 0.0) + points
    for node in root.elements():
        if node in out or node.tag in ("article", "main"):
            prior = 25 * ((node.tag in ("article", "main") or node.attrs.get("role") in ("main", "article")) + _named(node, _GOOD) - _named(node, _BAD))
            out[node] = out.get(node, 0.0) + prior
    for node in out:
        letters = len(node.text())
        linked = sum(len(e.text()) for e in node.elements() if e.tag == "a")
        out[node] *= 1 - min(1.0, linked / letters) if letters else 0.0
    return out


def main_parts(root: Node) -> list[Node]:
    """The element with the main content, and those beside it that belong to it, in page order; the body where there is none."""
    tree = pruned(root)
    told = {n: s for n, s in scores(tree).items() if n.tag not in ("#", "html")}
    body = next((e for e in tree.elements() if e.tag == "body"), tree)
    if not told:
        return [body]
    top = max(told, key=lambda n: told[n])
    if top.tag == "body" or told[top] <= 0:
        return [body]
    parts = []
    for c in top.parent.children:
        if c is top or (isinstance(c, Node) and told.get(c, 0) >= max(FEW, NEAR * told[top])):
            parts.append(c)
    if len(" ".join(p.text() for p in parts)) < SHORT and not any(p.tag in ("article", "main") for p in parts):
        return [body]
    return parts


def main_text(html: str | None) -> str:
    return " ".join(t for t in (p.text() for p in main_parts(parse(html))) if t)


def _inline(node: Node) -> str:
    """An element's text with its inline marks."""
    out = []
    for c in node.children:
        if isinstance(c, str):
            out.append(re.sub(r"\s+", " ", c))
        elif c.tag in SILENT:
            continue
        elif c.tag == "br":
            out.append("  \n")
        elif c.tag == "img":
            out.append(f"![{c.attrs.get('alt', '')}]({c.attrs.get('src', '')})")
        else:
            own = _inline(c)
            mark = {"b": "**", "strong": "**", "i": "*", "em": "*", "code": "`", "kbd": "`", "del": "~~", "s": "~~"}.get(c.tag)
            if c.tag == "a" and own.strip():
                own = f"[{own.strip()}]({c.attrs.get('href', '')})"
            elif mark and own.strip():
                lead, rest = own[: len(own) - len(own.lstrip())], own[len(own.rstrip()) :]
                own = f"{lead}{mark}{own.strip()}{mark}{rest}"
            out.append(own)
    return "".join(out)


def _cell(node: Node) -> str:
    return " ".join(" ".join(_blocks(node)).split()).replace("|", "\\|")


def _table(node: Node) -> str:
    rows = [[_cell(c) for c in r.children if isinstance(c, Node) and c.tag in ("td", "th")] for r in node.elements() if r.tag == "tr"]
    rows = [r for r in rows if r]
    if not rows:
        return ""
    width = max(map(len, rows))
    lines = [f"| {' | '.join([*r, *[''] * (width - len(r))])} |" for r in rows]
    return "\n".join([lines[0], f"|{' --- |' * width}", *lines[1:]])


def _list(node: Node) -> str:
    out, n = [], 1
    try:
        n = int(node.attrs.get("start") or 1)
    except ValueError:
        pass
    for c in node.children:
        if not isinstance(c, Node):
            continue
        if c.tag in ("ul", "ol"):
            out.append("    " + _list(c).replace("\n", "\n    "))
            continue
        mark = f"{n}. " if node.tag == "ol" else "* "
        n += 1
        parts = _blocks(c)
        if parts:
            nested = any(isinstance(x, Node) and x.tag in ("p", "pre", "blockquote", "table") for x in c.children)
            out.append(mark + ("\n\n" if nested else "\n").join(parts).replace("\n", "\n" + " " * len(mark)))
    return "\n".join(out)


def _blocks(node: Node) -> list[str]:
    """An element's blocks as Markdown."""
    out, run = [], Node("#", {}, None)

    def flush():
        # A line break comes of br alone.
        text = re.sub(r" *\n *", "  \n", re.sub(r" {2,}", " ", _inline(run)).strip())
        if text:
            out.append(text)
        run.children = []

    for c in node.children:
        if isinstance(c, str) or (c.tag not in BLOCK and not any(e.tag in BLOCK for e in c.elements())):
            run.children.append(c)
            continue
        flush()
        if c.tag in SILENT:
            continue
        if HEADING.fullmatch(c.tag):
            text = " ".join(_inline(c).split())
            if text:
                out.append(f"{'#' * int(c.tag[1])} {text}")
        elif c.tag in ("ul", "ol"):
            out.append(_list(c))
        elif c.tag == "table":
            out.append(_table(c))
        elif c.tag == "pre":
            raw = "".join(x if isinstance(x, str) else "".join(y for y in x.children if isinstance(y, str)) for x in c.children).strip("\n")
            out.append(f"```\n{raw}\n```")
        elif c.tag == "blockquote":
            out.append("\n".join(f"> {line}".rstrip() for line in "\n\n".join(_blocks(c)).split("\n")))
        elif c.tag == "hr":
            out.append("---")
        else:
            out += _blocks(c)
    flush()
    return [b for b in out if b.strip()]


def markdown(node: Node) -> str:
    return "\n\n".join(_blocks(node))
