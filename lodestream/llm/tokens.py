"""Encoding texts with a word-level BPE vocabulary file of the tokenizers library.

A text falls into words that the merges never cross, so ids are kept per word in a bounded
dictionary and joined. A batch's distinct pieces between white space are split together, as one
text of lines. Pieces outside Latin-1 go through the library's own normaliser and splitter; Latin-1
ones are split by an equal regular expression.
"""

from __future__ import annotations

import json
import re
import sys
from array import array
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Entries of a worker's dictionary of words, which is emptied when full.
WORDS = 700_000

# The splitter's pattern for lower-case Latin-1 texts.
_LETTER = "a-zA-ZªµºÀ-ÖØ-öø-ÿ"
_NUMBER = "0-9²³¹¼-¾"
_SPACE = "\t\n\x0b\x0c\r \u0085 "
_PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[{_NUMBER}]|[^{_SPACE}{_LETTER}{_NUMBER}]+"
_SPLIT, _LINES = re.compile(_PATTERN), re.compile(_PATTERN + "|\n")
_LITTLE = sys.byteorder == "little" and array("I").itemsize == 4
_BEYOND = re.compile("[^\x00-\xff]")


def byte_letters() -> dict[int, str]:
    """The printable character that byte-level vocabularies use for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {b: chr(b) for b in plain}
    for n, b in enumerate(b for b in range(256) if b not in out):
        out[b] = chr(256 + n)
    return out


class _Words(dict):
    def __init__(self, encode: Callable[[str], bytes], most: int):
        super().__init__()
        self._encode, self._most = encode, most

    def __missing__(self, word: str) -> bytes:
        if len(self) >= self._most:
            self.clear()
        ids = self._encode(word) if word != "\n" else b""
        if len(word) < 64:
            self[word] = ids
        return ids


class Encoder:
    """encode(text) gives little-endian unsigned 32-bit ids, equal to the library's with add_special_tokens=False."""

    def __init__(self, path: str, word_ids: Callable[[str], list[int]] | None = None, most: int = WORDS):
        from tokenizers import Tokenizer

        self.path = path
        self.lib = Tokenizer.from_file(path)
        self.lib.no_truncation()
        self.lib.no_padding()
        kind = json.loads(self.lib.to_str().split('"model"')[0].rstrip(", ") + "}")["pre_tokenizer"]
        steps = [p["type"] for p in kind.get("pretokenizers", [])]
        if steps != ["Split", "ByteLevel"]:
            raise ValueError("the vocabulary must split by a pattern and then map bytes")
        self._to_byte = {c: b for b, c in byte_letters().items()}
        self._to_char = byte_letters()
        added = self.lib.get_added_tokens_decoder()
        self._special = {t.content: i for i, t in added.items()}
        self._special_re = re.compile("|".join(map(re.escape, sorted(self._special, key=len, reverse=True)))) if added else None
        self._plain = not any(s.isascii() and s.isalpha() for s in self._special)
        tokenize = self.lib.model.tokenize
        self._model_ids = word_ids or (lambda chars: [t.id for t in tokenize(chars)])
        self._words = _Words(self._word, most)

    def chars(self, word: str) -> str:
        # Letters and digits of ASCII stand for themselves.
        return word if word.isascii() and word.isalnum() else "".join(map(self._to_char.__getitem__, word.encode()))

    def _word(self, word: str) -> bytes:
        # Letters and digits of ASCII stand for themselves.
        ids = self._model_ids(word if word.isascii() and word.isalnum() else self.chars(word))
        return array("I", ids).tobytes() if _LITTLE else np.array(ids, "<u4").tobytes()

    def words(self, text: str) -> list[str]:
        """The words of a text without special tokens."""
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            norm = self.lib.normalizer.normalize_str(text)
            return [bytes(map(self._to_byte.__getitem__, p)).decode() for p, _ in self.lib.pre_tokenizer.pre_tokenize_str(norm)]
        return _SPLIT.findall(text.lower())

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        get = self._words.__getitem__
        if self._plain and text.isascii() and text.isalpha():
            return get(text.lower())
        if self._special_re is None or not self._special_re.search(text):
            return b"".join(map(get, self.words(text)))
        out, at = [], 0
        for m in self._special_re.finditer(text):
            out += map(get, self.words(text[at : m.start()]))
            out.append(np.uint32(self._special[m[0]]).astype("<u4").tobytes())
            at = m.end()
        out += map(get, self.words(text[at:]))
        return b"".join(out)

    def _odd(self, piece: str) -> bool:
        return _BEYOND.search(piece) is not None or (self._special_re is not None and self._special_re.search(piece) is not None)

    def _coded(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of pieces without ASCII white space, joined, and how many each has."""
        if not len(pieces):
            return np.empty(0, np.uint32), np.empty(0, np.int64)
        text = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(pieces)], pa.int32()), pieces), "\n")[0].as_py()
        if self._odd(text):
            # Few pieces are odd; the others are coded together.
            every = pieces.to_pylist()
            odd = np.fromiter(map(self._odd, every), bool, len(every))
            apart = {i: self.encode(every[i]) for i in np.flatnonzero(odd).tolist()}
            flat, size = self._coded(pieces.filter(pa.array(~odd)))
            whole = np.zeros(len(every), np.int64)
            whole[~odd] = size
            ends = np.cumsum(whole)
            cuts = [0, *(int(ends[i]) for i in apart), len(flat)]
            parts = [x for a, b, ids in zip(cuts, cuts[1:], [*apart.values(), b""], strict=False) for x in (flat[a:b], np.frombuffer(ids, "<u4"))]
            for i, ids in apart.items():
                whole[i] = len(ids) // 4
            return np.concatenate(parts), whole
        # A line break has no ids and ends a piece.
        ids = list(map(self._words.__getitem__, _LINES.findall(text.lower())))
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        ends = np.append(np.cumsum(size)[size == 0], size.sum())
        return np.frombuffer(b"".join(ids), "<u4"), np.diff(ends, prepend=0)

    def encode_batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts in one array, and where each text begins in it (n + 1 offsets).

        Distinct pieces between ASCII white space are coded once per batch, as the merges cross none.
        """
        texts = pc.fill_null(texts, "")
        pieces = pc.ascii_split_whitespace(texts)
        bounds = pieces.offsets.to_numpy().astype(np.int64)
        coded = pieces.values.slice(bounds[0], bounds[-1] - bounds[0]).dictionary_encode()
        bounds = bounds - bounds[0]
        if not len(coded):
            return np.empty(0, np.uint32), np.zeros(len(texts) + 1, np.int64)
        flat, size = self._coded(coded.dictionary)
        at = coded.indices.to_numpy()
        lengths = size[at]
        ends = np.cumsum(lengths)
        first = (np.cumsum(size) - size)[at] - (ends - lengths)
        # Places of a batch fit 32 bits.
        kind = np.int32 if ends[-1] < 1 << 31 and len(flat) < 1 << 31 else np.int64
        out = flat[np.repeat(first.astype(kind), lengths) + np.arange(int(ends[-1]), dtype=kind)]
        return out, np.concatenate([[0], ends])[bounds]


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder per worker and vocabulary file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    """The default place of a vocabulary file; every operator takes the path as a parameter."""
    import public_tokenizers

    return public_tokenizers.path(name)
