"""Secret scans: base patterns, and Shannon entropy in sliding windows over candidate strings.

A candidate is a run of base64 letters. A window of fixed width moves over it one letter at a
time; counts per character are updated as letters enter and leave, so the entropy of every window
costs constant time. A window counts if its entropy reaches the bound of its character class
(hexadecimal digits; lower-case letters and digits; upper-case letters and digits; letters and digits
in both cases; base64 with any number of symbols) and it holds the kinds of characters that random
strings have. Adjacent windows are joined. What a base span, a UUID, or an address on the web covers
is not told again, nor what stands within REACH letters of a string that documentation uses in place
of secrets; of the parts that are left, those without a digit or of few different letters are
suppressed. So an allow-listed string takes its own surroundings away, never a whole long span.

Spans are code points, end exclusive. Kinds: assign, access, hex, then entropy (added by the method).
Defined results: a null or empty text has no spans; equal texts have equal spans; repeated rows are
kept; spans that begin together come in the order of the kinds; a very long text takes time linear in
its length; an empty table gives no rows; other columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "entropy")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
#: Width of the window and the least bits per letter, by class.
WINDOW, HEX_BITS, MIXED_BITS, LOWER_BITS, UPPER_BITS, BASE64_BITS = 20, 3.0, 3.6, 3.5, 3.4, 3.8
# Strings that documentation uses in place of secrets.
ALLOWED = ("EXAMPLE", "example", "XXXX", "xxxx", "0123456789", "abcdefghij", "ABCDEFGHIJ", "deadbeef", "1234567890", "placeholder")
_UUID = re.compile(r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}")
_ADDRESS = re.compile(r"(?<![A-Za-z0-9])(?:https?://|www\.)[^\s\"'<>]*")
#: A part between slashes that is more than a word, and the words of a name.
_ODD = re.compile(r"[0-9+]|[a-z][A-Z]|[A-Z]{2}")
_NAMED = re.compile(r"[A-Z]?[a-z]{3,}")
#: The share of its letters that words have in a name.
NAME = 0.7
_ALLOWED = re.compile("|".join(ALLOWED))
#: Letters before and after an allow-listed string that are suppressed with it: as many as documented keys have.
REACH = 40
_DIGIT = re.compile(r"[0-9]")
_BITS = [n * math.log2(n) if n else 0.0 for n in range(WINDOW + 1)]
_LIKELY = r"(?i)(password|passwd|secret|token|api_?key)|[A-Za-z0-9+/_=\-]{20}"


def base_spans(text: str) -> list[tuple[int, int, str]]:
    spans = [(*m.span(), "assign") for m in ASSIGN.finditer(text) if len(m[1]) >= 6]
    spans += [(*m.span(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    spans += [(*m.span(), "hex") for m in HEX.finditer(text)]
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[2])))


def _class(upper: int, lower: int, digit: int, odd: int, beyond: int) -> float | None:
    """The least entropy of a window with so many letters of each sort (beyond: letters outside a-f), or None."""
    if not digit:
        return None
    if upper >= 3 and lower >= 3:
        if odd <= 2 and digit >= 3:
            return MIXED_BITS
        # Names of many words have fewer letters of either case, and digits are few in base64.
        return BASE64_BITS if upper >= (6 if odd <= 2 else 5) and lower >= 5 else None
    if odd > 2 or (upper and lower):
        return None
    if not beyond and not odd:
        return HEX_BITS if digit >= 3 and upper + lower >= 3 else None
    # Base32 has six digits among 32 letters.
    return UPPER_BITS if upper >= 3 else LOWER_BITS if lower >= 3 and digit >= 2 else None


def entropy_spans(text: str) -> list[tuple[int, int]]:
    """The tokens of joined windows that count, but for names, whatever else is known of their letters."""
    out: list[tuple[int, int]] = []
    found: list[tuple[int, int]] = []
    for m in CANDIDATE.finditer(text):
        run = m[0]
        if run.isalpha():
            continue
        counts: dict[str, int] = {}
        sort = [0, 0, 0, 0, 0]
        total = 0.0

        def move(c: str, by: int) -> None:
            nonlocal total
            n = counts.get(c, 0)
            total += _BITS[n + by] - _BITS[n]
            counts[c] = n + by
            k = 0 if "A" <= c <= "Z" else 1 if "a" <= c <= "z" else 2 if "0" <= c <= "9" else 3
            sort[k] += by
            if k < 2 and c not in "abcdefABCDEF":
                sort[4] += by

        for i, c in enumerate(run):
            move(c, 1)
            if i >= WINDOW:
                move(run[i - WINDOW], -1)
            if i >= WINDOW - 1:
                least = _class(*sort)
                if least is not None and math.log2(WINDOW) - total / WINDOW >= least:
                    a, b = m.start() + i - WINDOW + 1, m.start() + i + 1
                    if found and a <= found[-1][1]:
                        found[-1] = (found[-1][0], b)
                    else:
                        found.append((a, b))
        # Tokens of the run's windows; those that meet are one.
        whole: list[tuple[int, int]] = []
        while found and found[-1][0] >= m.start():
            whole.append(found.pop())
        for a, b in reversed(whole):
            if out and b <= out[-1][1]:
                continue
            a, b = grown(text, m.span(), a, b)
            if out and a <= out[-1][1]:
                out[-1] = (out[-1][0], max(b, out[-1][1]))
            else:
                out.append((a, b))
    return [(a, b) for a, b in out if not is_name(text[a:b])]


def grown(text: str, run: tuple[int, int], a: int, b: int) -> tuple[int, int]:
    """The token around text[a:b] in its run of candidate letters."""
    low, high = run
    sign = text.rfind("=", low, a) + 1
    low = max(low, sign)
    while a > low:
        cut = text.rfind("/", low, a) + 1 or low
        if cut == a:  # a slash stands just before
            before = max(text.rfind("/", low, a - 1) + 1, low)
            if not _ODD.search(text, before, a - 1):
                break
            a = before
        else:
            a = cut
    while b < high and text[b] != "=" and text[b - 1] != "=":
        ends = [x for x in (text.find("/", b, high), text.find("=", b, high)) if x >= 0]
        cut = min(ends, default=high)
        if cut == b:  # a slash stands just behind
            ends = [x for x in (text.find("/", b + 1, high), text.find("=", b + 1, high)) if x >= 0]
            cut = min(ends, default=high)
            if not _ODD.search(text, b + 1, cut):
                break
        b = cut
    for _ in range(2):
        b += b < high and text[b] == "="
    return a, b


def is_name(part: str) -> bool:
    """Whether a string in both cases is made of words for the most part, such as a name in a program."""
    letters = sum(c.isalpha() for c in part)
    return part.lower() != part and part.upper() != part and sum(len(w) for w in _NAMED.findall(part)) >= NAME * letters


def uncovered(spans: list[tuple[int, int]], covers: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The parts of spans (sorted, apart) that no cover (sorted by start) covers."""
    out, i, reach = [], 0, 0
    for a, b in spans:
        while i < len(covers) and covers[i][0] <= a:
            reach, i = max(reach, covers[i][1]), i + 1
        a = max(a, reach)
        while i < len(covers) and covers[i][0] < b:
            x, y = covers[i]
            if x > a:
                out.append((a, x))
            reach, i = max(reach, y), i + 1
            a = max(a, reach)
        if a < b:
            out.append((a, b))
    return out


def suppressed(text: str) -> list[tuple[int, int]]:
    """UUIDs, addresses on the web, and what stands near an example in the same run of letters."""
    out = [m.span() for m in _UUID.finditer(text)] + [m.span() for m in _ADDRESS.finditer(text)]
    if _ALLOWED.search(text):
        for run in CANDIDATE.finditer(text):
            out += [(max(run.start(), m.start() - REACH), min(run.end(), m.end() + REACH)) for m in _ALLOWED.finditer(text, *run.span())]
    return out


def spans_of(text: str | None) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """Base spans, and all spans, by start and kind."""
    if not text:
        return [], []
    base = base_spans(text)
    found = entropy_spans(text)
    parts = uncovered(found, sorted([(a, b) for a, b, _ in base] + suppressed(text))) if found else []
    more = [(a, b, "entropy") for a, b in parts if _DIGIT.search(text, a, b) and len(set(text[a:b])) >= 8]
    return base, sorted(base + more, key=lambda s: (s[0], KINDS.index(s[2])))


def listed(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, base and spans (kind:start:end, joined by commas), and counts of the base kinds."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in (b.slice(i, j - i) for b in batches for i, j in common.chunks(b.column(1))):
            # The library's linear scan leaves few texts to the patterns.
            likely = pc.match_substring_regex(pc.fill_null(batch.column(1), ""), _LIKELY).to_pylist()
            found = [spans_of(t.as_py()) if x else ([], []) for t, x in zip(batch.column(1), likely, strict=True)]
            counts = [pa.array([sum(s[2] == k for s in base) for base, _ in found], pa.int64()) for k in KINDS[:3]]
            text = [pa.array([listed(x[i]) for x in found], pa.string()) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *counts, *text], ["doc_id", "n_assign", "n_access", "n_hex", "base", "spans"])

    rows = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return common.map_arrow(rows, run, f"doc_id {kind}, n_assign long, n_access long, n_hex long, base string, spans string")


def digest(spans) -> str:
    return hashlib.sha256(listed(spans).encode()).hexdigest()


def op10_secrets(spark, sf_dir: str) -> DataFrame:
    found = scan(common.spread(common.table(spark, sf_dir, "documents")))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(F.encode("base", "UTF-8"), 256).alias("base_sha256"), "spans")
