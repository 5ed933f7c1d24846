"""BPE encoding by dynamic programming over prefixes, and decoding.

For every prefix of a word exactly one token can be the last one of its encoding. A suffix automaton of
the vocabulary follows the longest end of the prefix that lies in any token; the suffix links from there
pass all tokens that end at this place. Of these, the one that is compatible with the
last token of the prefix before it is stored. Back-pointers from the end give the ids. Two tokens
are compatible if the merge order never joins symbols across their border: the symbols at the
border are followed in merge order along the right side of the one token and the left side of the
other.

Defined results: a null or empty text has no ids and decodes to ""; repeated rows and rows without an
id are kept; no two tokens can both be the last of a prefix, so there are no ties; a very long text is
taken alone, a very long word in time linear in its length times the longest token's; an empty table
gives no rows; other columns of the input are ignored.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .tokens import Encoder, encoder, vocabulary

_END = "\x00"
_PAIRS = 600_000
#: Words kept beside them.
WORDS = 450_000
#: Bytes of text encoded at a time (a longer text is taken alone).
PART_BYTES = 6_000_000


class SuffixAutomaton:
    """Of many strings with a value each. A state stands for the substrings that end at the same places of them.

    A string is the longest of its state, as it begins where nothing stands before it, so that a state
    has one value at most.
    """

    def __init__(self, values: dict[str, object]):
        length, link, value = [0], [-1], [None]
        self.step: dict[int, int] = {}
        self.code = {c: i for i, c in enumerate(sorted({c for s in values for c in s}))}
        self.width = width = max(len(self.code), 1)
        step, below = self.step, [{}]  # transitions by state while it is built, for copies
        for string, what in values.items():
            last = 0
            for c in string:
                c = self.code[c]
                if c in below[last]:
                    q = below[last][c]
                    if length[q] == length[last] + 1:
                        last = q
                        continue
                    p, last = last, self._copy(length, link, value, below, q, length[last] + 1)
                    while p >= 0 and below[p].get(c) == q:
                        below[p][c] = last
                        p = link[p]
                    continue
                new, p = len(length), last
                length.append(length[last] + 1)
                link.append(0)
                value.append(None)
                below.append({})
                while p >= 0 and c not in below[p]:
                    below[p][c] = new
                    p = link[p]
                if p >= 0:
                    q = below[p][c]
                    if length[q] == length[p] + 1:
                        link[new] = q
                    else:
                        link[new] = copy = self._copy(length, link, value, below, q, length[p] + 1)
                        while p >= 0 and below[p].get(c) == q:
                            below[p][c] = copy
                            p = link[p]
                last = new
            value[last] = what
        for state, to in enumerate(below):
            for c, q in to.items():
                step[state * width + c] = q
        self.length, self.link, self.value = length, link, value
        # The next state of a string on the way of the suffix links.
        self.ends = [0] * len(length)
        for state in sorted(range(1, len(length)), key=length.__getitem__):
            up = link[state]
            self.ends[state] = up if value[up] is not None else self.ends[up]

    @staticmethod
    def _copy(length, link, value, below, q: int, size: int) -> int:
        """A state like q for its substrings of at most `size` letters, which q then continues."""
        length.append(size)
        link.append(link[q])
        value.append(None)
        below.append(dict(below[q]))
        link[q] = len(length) - 1
        return link[q]

    def iter(self, text: str):
        """Place of the last letter and value of every string in a text, longer ones first."""
        step, width, link, length, value, ends, codes = self.step, self.width, self.link, self.length, self.value, self.ends, self.code
        state = held = 0
        for at, letter in enumerate(text):
            c = codes.get(letter)
            if c is None:
                state = held = 0
                continue
            to = step.get(state * width + c)
            while to is None and state:
                state = link[state]
                held = length[state]
                to = step.get(state * width + c)
            if to is None:
                held = 0
                continue
            state, held = to, held + 1
            end = state if length[state] == held and value[state] is not None else ends[state]
            while end:
                yield at, value[end]
                end = ends[end]


class PrefixCoder:
    """Ids of one word, given as byte letters."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        suffix = model.get("end_of_word_suffix") or ""
        self.suffix = suffix
        self.vocab: dict[str, int] = model["vocab"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        never = len(merges)
        made = {}
        self.rank: dict[tuple[int, int], tuple[int, int]] = {}
        for r, (a, b) in enumerate(merges):
            x = (self.vocab[a], self.vocab[b])
            whole = self.vocab[a + b]
            self.rank[x] = (r, whole)
            made.setdefault(whole, (r, *x))
        # The symbols at a token's right and left side and the rank of the merge that ends each.
        self.right, self.left = {}, {}
        for i in self.vocab.values():
            for sides, k in ((self.right, 2), (self.left, 1)):
                chain, x, ends = [], i, never
                while True:
                    chain.append((x, ends))
                    if x not in made:
                        break
                    ends, x = made[x][0], made[x][k]
                sides[i] = chain[::-1]
        self.never = never
        words = {}
        for t, i in self.vocab.items():
            if suffix and t.endswith(suffix) and t != suffix:
                word = t[: -len(suffix)] + _END
                size = len(word) - 1
            else:
                word, size = t, len(t)
            if self._reachable(i, made):
                words[word] = (i, size)
        self.automaton = SuffixAutomaton(words)
        self._known: dict[int, bool] = {}

    def _reachable(self, i: int, made: dict) -> bool:
        """Whether merging a token's own letters gives the token."""
        return i not in made or self.compatible(made[i][1], made[i][2], made[i][0])

    def compatible(self, a: int, b: int, least: int | None = None) -> bool:
        """Whether a then b stays two tokens; with `least`, whether they stay two until the merge of that rank."""
        right, left = self.right[a], self.left[b]
        i = j = 0
        stop = self.never if least is None else least
        while True:
            x, x_ends = right[i]
            y, y_ends = left[j]
            joins = self.rank.get((x, y))
            # On equal ranks the pair further left goes first.
            if joins and joins[0] < stop and joins[0] < x_ends and joins[0] <= y_ends:
                return False
            if i + 1 == len(right) and j + 1 == len(left):
                return True
            if x_ends <= y_ends and i + 1 < len(right):
                i += 1
                if x_ends == y_ends and j + 1 < len(left):
                    j += 1
            elif j + 1 < len(left):
                j += 1
            else:
                i += 1

    def __call__(self, chars: str) -> list[int]:
        n = len(chars)
        if not n:
            return []
        last: list[tuple[int, int] | None] = [None] * (n + 1)
        known, automaton = self._known, self.automaton
        step, width, link, length, value, ends, codes = automaton.step, automaton.width, automaton.link, automaton.length, automaton.value, automaton.ends, automaton.code.get
        state = held = 0
        # The automaton's own walk, as in iter, left off at each place once its last token is known.
        for place, letter in enumerate(chars + (_END if self.suffix else ""), 1):
            c = codes(letter)
            if c is None:
                state = held = 0
                continue
            to = step.get(state * width + c)
            while to is None and state:
                state = link[state]
                held = length[state]
                to = step.get(state * width + c)
            if to is None:
                held = 0
                continue
            state, held = to, held + 1
            end = state if length[state] == held and value[state] is not None else ends[state]
            at = n if place > n else place
            if at == n and self.suffix and place == n:
                continue  # the last letter counts only together with the end of the word
            while end:
                token, size = value[end]
                begin = at - size
                if not begin:
                    last[at] = (token, 0)
                    break
                before = last[begin]
                if before is not None:
                    pair = before[0] << 32 | token
                    fits = known.get(pair)
                    if fits is None:
                        if len(known) >= _PAIRS:
                            known.clear()
                        fits = known[pair] = self.compatible(before[0], token)
                    if fits:
                        last[at] = (token, begin)
                        break
                end = ends[end]
        out, at = [], n
        while at:
            token, at = last[at]
            out.append(token)
        return out[::-1]


_coders: dict[str, Encoder] = {}
_tokens: dict[str, list[str]] = {}


def _coder(path: str) -> Encoder:
    if path not in _coders:
        _coders[path] = Encoder(path, PrefixCoder(path), WORDS)
    return _coders[path]


def _names(path: str) -> list[str]:
    if path not in _tokens:
        lib = (_coders.get(path) or encoder(path)).lib
        _tokens[path] = [lib.id_to_token(i) or "" for i in range(lib.get_vocab_size())]
    return _tokens[path]


def _encoded(batches, path: str):
    enc = _coder(path)
    for batch in batches:
        texts = batch.column(1)
        for a, b in common.chunks(texts, PART_BYTES):
            flat, bounds = enc.encode_batch(texts.slice(a, b - a))
            for c in range(0, b - a, 2000):
                own = bounds[c : c + 2001]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a + c, len(own) - 1), common.slices_of(flat[own[0] : own[-1]].astype("<u4"), own - own[0])], ["doc_id", "ids"])


def _decoded(batches, path: str):
    names = _names(path).__getitem__
    for batch in common.small_batches(batches, 2000):
        texts = [" ".join(map(names, np.frombuffer(x, "<u4").tolist())) if x else "" for x in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["doc_id", "ids", "decoded"])


def _rows(df: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, str]:
    return df.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")), f"doc_id {df.schema[id_col].dataType.simpleString()}, ids binary"


def encode(df: DataFrame, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ids (binary, little-endian unsigned 32-bit)."""
    path = tokenizer or vocabulary()
    rows, kind = _rows(df, id_col, text_col)
    return common.map_arrow(rows, lambda batches: _encoded(batches, path), kind)


def decode(df: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Adds `decoded` to doc_id and ids: the tokens, special ones included, with spaces between them."""
    path = tokenizer or vocabulary()
    kind = df.schema["doc_id"].dataType.simpleString()
    return common.map_arrow(df.select("doc_id", "ids"), lambda batches: _decoded(batches, path), f"doc_id {kind}, ids binary, decoded string")


def encode_and_decode(df: DataFrame, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """decode(encode(df)) in one Python worker a task instead of two."""
    path = tokenizer or vocabulary()
    rows, kind = _rows(df, id_col, text_col)
    return common.map_arrow(rows, lambda batches: _decoded(_encoded(batches, path), path), f"{kind}, decoded string")


def op9_bpe(spark, sf_dir: str) -> DataFrame:
    both = encode_and_decode(common.spread(common.table(spark, sf_dir, "documents")))
    return both.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"))
