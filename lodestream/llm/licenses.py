"""License scans by conditional compression.

A block is the whole lines around words that license notices use, with as many words before and
behind as the longest wording can take, whatever breaks, comment marks and empty lines stand between:
a notice wrapped over many lines is one block. Each template is a raw zstandard dictionary; a block
is compressed without and with each, and the templates are ranked by how much smaller they make it.
All that make the block, or the wording alone, smaller by the least gain are confirmed by their exact
wording, wherever it begins in the block: the template's words are aligned with the words there, and
the words that differ are counted; numbers of versions must be the same. Of wordings that overlap the
one with the most words that agree stays, a differing word counting against three of them, and what
stands between the notices found is scanned again in the same way.

Spans are code points, from the first to the last word of a wording. Defined results: a null or
empty text has none; equal texts have equal findings; repeated rows are kept; of wordings that are
equal in this the one with fewer differences, then of more gain, then the earlier template stays; a
very long line is one block, scanned whole; an empty table gives no rows; other columns of the input are ignored.
"""

from __future__ import annotations

import difflib
import itertools
import math
import re
from collections import Counter

import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .license_texts import TEMPLATES, TEXTS

__all__ = ["TEMPLATES", "TEXTS", "Scanner", "scan"]
_TRIGGER = re.compile(r"licen[sc]|permission\x20|redistribut|copyright|spdx|public\x20domain", re.ASCII | re.IGNORECASE)
_LIKELY = r"(?i)licen[sc]|permission |redistribut|copyright|spdx|public domain"
_WORD = re.compile(r"[A-Za-z]+|[0-9]+(?:\.[0-9]+)*")
#: The least gain and share of words.
GAIN, SHARE = 0.25, 0.85
_SHORT, _LONG = 3, 20


def _before(text: str, at: int, floor: int, words: int) -> int:
    """Where the `words` words before `at` begin, not below floor."""
    size = 16 * words
    while True:
        low = max(floor, at - size)
        found = [m.start() for m in _WORD.finditer(text, low, at)]
        if low == floor or len(found) > words:  # the first may be cut
            return found[-words] if len(found) >= words else low
        size *= 2


def _behind(text: str, at: int, words: int) -> int:
    """Where the `words` words behind `at` end; `at` may cut one more."""
    found = [m.end() for m in itertools.islice(_WORD.finditer(text, at), words + 1)]
    return found[-1] if len(found) > words else len(text)


def blocks_of(text: str, reach: int) -> list[tuple[int, int]]:
    """Spans of the whole lines within `reach` words of a word that notices use; those that meet are joined."""
    out: list[tuple[int, int]] = []
    hit = _TRIGGER.search(text)
    while hit:
        first = last = hit
        # What is nearer than this is surely within reach.
        while (hit := _TRIGGER.search(text, last.end())) and hit.start() - last.end() < reach:
            last = hit
        low = _before(text, first.start(), out[-1][1] if out else 0, reach)
        a = text.rfind("\n", out[-1][1] if out else 0, low) + 1 or (out[-1][1] if out else 0)
        b = text.find("\n", _behind(text, last.end(), reach))
        b = len(text) if b < 0 else b
        if out and a <= out[-1][1] + 1:
            out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
        while hit and hit.end() <= b:
            # What the block holds already makes it longer.
            b = text.find("\n", _behind(text, hit.end(), reach))
            b = len(text) if b < 0 else b
            out[-1] = (out[-1][0], b)
            last, hit = hit, _TRIGGER.search(text, hit.end())
    return out


def words(text: str) -> list[str]:
    return [w.lower() for w in _WORD.findall(text)]


class Scanner:
    def __init__(self, templates: dict[str, tuple[str, ...]]):
        self.plain = zstandard.ZstdCompressor(level=3, write_content_size=False)
        self.rows = []
        self.counts = []
        for name, texts in templates.items():
            for t in texts:
                own = zstandard.ZstdCompressionDict(t.encode() if len(t) >= 8 else (t * 8).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                self.rows.append((name, t, tuple(words(t)), zstandard.ZstdCompressor(level=3, dict_data=own, write_content_size=False, write_dict_id=False)))
                self.counts.append(Counter(self.rows[-1][2]))
        # A wording has at most its own length and ten words between.
        self.reach = max((2 * len(r[2]) + 10 for r in self.rows), default=0)

    def gains(self, block: str) -> list[tuple[float, int]]:
        """How much smaller each template makes the block, relative to the template's size, best first."""
        return sorted(((self.gain(i, block), i) for i in range(len(self.rows))), reverse=True)

    def gain(self, i: int, block: str) -> float:
        data = block.encode()
        base = len(self.plain.compress(data))
        return (base - len(self.rows[i][3].compress(data))) / min(len(self.rows[i][1]), base)

    def spread(self, i: int, own: list[str]) -> tuple[int, int, int, int] | None:
        """Differing words, agreeing words, first word and end of the template's wording with any number of words between; None if it isn't there."""
        template = self.rows[i][2]
        same = [m for m in difflib.SequenceMatcher(None, template, own, autojunk=False).get_matching_blocks() if m.size]
        agree = sum(m.size for m in same)
        if agree < max(_SHORT, SHARE * len(template)):
            return None
        kept = {x for m in same for x in range(m.a, m.a + m.size)}
        if any(x not in kept and template[x][0].isdigit() for x in range(len(template))):
            return None
        between = sum(y.b - x.b - x.size for x, y in zip(same, same[1:], strict=False))
        return len(template) - agree + between, agree, same[0].b, same[-1].b + same[-1].size

    def wordings(self, i: int, own: list[str]) -> list[tuple[int, int, int, int]]:
        """The same for every place where the wording begins, with at most its own length and ten words more between; they may overlap."""
        template = self.rows[i][2]
        least = max(_SHORT, math.ceil(SHARE * len(template)))
        if least > len(template):
            return []
        # One of these is the first word that agrees.
        first = {w: x for x, w in reversed(list(enumerate(template[: len(template) - least + 1])))}
        needed, numbers, out, done, sure = self.counts[i], {w for w in template if w[0].isdigit()}, [], 0, 0
        for at, word in enumerate(own):
            x = first.get(word)
            if x is None or at < done or any(w[0].isdigit() for w in template[:x]):
                continue
            window = own[at : at + 2 * len(template) + 10]
            if tuple(window[: len(template)]) == template:
                done = at + len(template)
                out.append((0, len(template), at, done))
                continue
            # Within a wording that differs only a whole one is looked for, and a long one begins where most of its next words follow.
            if at < sure or len(template) > _LONG and len(set(template[x : x + 8]).intersection(window[:10])) < 5:
                continue
            if not numbers.issubset(window) or sum((needed & Counter(window)).values()) < least:
                continue
            # The fewest differences; if these leave out too many words, the fewest words left out.
            for weight in (1, len(window)):
                found = _align(template, x, window, weight)
                if found and len(template) - found[0] >= least:
                    out.append((found[0] + found[1], len(template) - found[0], at, at + found[2]))
                    sure = at + found[2]
                    break
        return out

    def notices(self, text: str) -> list[tuple[int, int, str, float, int]]:
        """Start, end, license, gain and differing words of every notice of a block."""
        tokens = [(m[0].lower(), *m.span()) for m in _WORD.finditer(text)]
        out, parts = [], [(0, len(tokens))]
        while parts:
            low, high = parts.pop()
            if high - low < _SHORT:
                continue
            own = [w for w, _, _ in tokens[low:high]]
            held = Counter(own)
            sure, ranked = [], self.gains(text[tokens[low][1] : tokens[high - 1][2]])
            likely = {i for i, n in enumerate(self.counts) if sum((n & held).values()) >= SHARE * n.total()}
            for g, i in ranked:
                for d, n, a, b in self.wordings(i, own) if i in likely else ():
                    # Among many notices a template may gain little over those like it: then the wording is measured alone.
                    gain = g if g >= GAIN else self.gain(i, text[tokens[low + a][1] : tokens[low + b - 1][2]])
                    if gain >= GAIN:
                        sure.append((3 * d - n, d, -gain, i, a, b))
            if not sure:
                sure = sorted((3 * d[0] - d[1], d[0], -g, i, *d[2:]) for g, i in ranked if g >= GAIN and i in likely and (d := self.spread(i, own)))[:1]
            taken, at = bytearray(len(own)), []
            for _, d, g, i, a, b in sorted(sure):
                if not any(taken[a:b]):
                    taken[a:b] = b"\1" * (b - a)
                    at.append((a, b))
                    out.append((tokens[low + a][1], tokens[low + b - 1][2], self.rows[i][0], -g, d))
            if at:
                at.sort()
                parts += [(low + a, low + b) for a, b in zip([0, *(b for _, b in at)], [*(a for a, _ in at), len(own)], strict=True)]
        return sorted(out)

    def find(self, text: str | None) -> list[tuple[int, int, str, float, int]]:
        """Start, end, license, gain and differing words of every confirmed notice."""
        return [(a + x, a + y, *rest) for a, b in blocks_of(text or "", self.reach) for x, y, *rest in self.notices(text[a:b])]


def _align(template: list[str], x: int, window: list[str], weight: int) -> tuple[int, int, int] | None:
    """Words left out, words between and end of the template's wording whose word x is the window's first; a word left out costs weight, one between 1, numbers stay."""
    far = (float("inf"), 0, 0)
    row = [(weight * x, x, 0)] + [far] * (len(window) - 1)
    for w in template[x + 1 :]:
        lost = (float("inf"), 0, 0) if w[0].isdigit() else (weight, 1, 0)
        new, before = [], far
        for y, own in enumerate(window):
            # Column y: the window's words up to y are used.
            cost, left, more = row[y]
            best = (cost + lost[0], left + lost[1], more)
            if before[0] + 1 < best[0]:
                best = (before[0] + 1, before[1], before[2] + 1)
            if y and w == own and row[y - 1][0] <= best[0]:
                best = row[y - 1]
            new.append(best)
            before = best
        row = new
    cost, y = min((c[0], y) for y, c in enumerate(row))
    return (row[y][1], row[y][2], y + 1) if cost < float("inf") else None


def scan(df: DataFrame, templates: dict[str, tuple[str, ...]] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and findings: start, end, license, gain, edits."""
    templates = templates or TEMPLATES
    kind = df.schema[id_col].dataType.simpleString()
    shape = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("license", pa.string()), ("gain", pa.float64()), ("edits", pa.int64())]))

    def run(batches):
        scanner = Scanner(templates)
        for batch in (b.slice(i, j - i) for b in batches for i, j in common.chunks(b.column(1))):
            likely = pc.match_substring_regex(pc.fill_null(batch.column(1), ""), _LIKELY).to_pylist()
            found = [[dict(zip(("start", "end", "license", "gain", "edits"), x, strict=True)) for x in scanner.find(t.as_py())] if y else [] for t, y in zip(batch.column(1), likely, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, shape)], ["doc_id", "findings"])

    rows = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return common.map_arrow(rows, run, f"doc_id {kind}, findings array<struct<start:long,end:long,license:string,gain:double,edits:long>>")


def op6_licenses(spark, sf_dir: str) -> DataFrame:
    found = scan(common.spread(common.table(spark, sf_dir, "documents")))
    text = F.transform("findings", lambda x: F.concat_ws(":", x.license, x.start.cast("string"), x.end.cast("string"), x.edits.cast("string")))
    return found.select("doc_id", F.size("findings").cast("long").alias("n_licenses"), F.array_join(text, ",").alias("licenses"))
