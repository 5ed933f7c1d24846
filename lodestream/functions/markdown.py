"""Markdown parts of messages: fenced code first, then tables, the rest plain; a pure core and an Arrow map."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_FENCE = re.compile(r"^ {0,3}(`{3,}|~{3,})(.*)$")
_SEPARATOR = re.compile(r"^:?-+:?$")


def split_row(row: str) -> list[str]:
    """Trimmed cells of a table row; an escaped pipe is part of its cell and keeps its backslash."""
    edge = row.strip()
    cells = [c.strip() for c in re.sub(r"(\\.)|\|", lambda m: m[1] or "\0", edge).split("\0")]
    return cells[edge.startswith("|") : len(cells) - (len(cells) > 1 and not cells[-1])]


def has_pipe(row: str) -> bool:
    return re.search(r"(?<!\\)(?:\\\\)*\|", row) is not None


def table_at(lines: list[str], i: int) -> int | None:
    """The line after the table that begins at line i."""
    if i + 1 >= len(lines) or re.match(r" {4}|\t", lines[i]) or not has_pipe(lines[i]):
        return None
    head, mark = split_row(lines[i]), split_row(lines[i + 1])
    if len(head) != len(mark) or not all(_SEPARATOR.match(c) for c in mark):
        return None
    j = i + 2
    while j < len(lines) and lines[j].strip() and "|" in lines[j]:
        j += 1
    return j


def code_at(lines: list[str], i: int) -> tuple[int, int] | None:
    """The line after the code block that begins at line i, and where its text ends; an open block runs to the end."""
    m = _FENCE.match(lines[i])
    if not m or m[1][0] == "`" and "`" in m[2]:
        return None
    for j in range(i + 1, len(lines)):
        c = _FENCE.match(lines[j])
        if c and c[1][0] == m[1][0] and len(c[1]) >= len(m[1]) and not c[2].strip():
            return j + 1, j
    return len(lines), len(lines)


def split_message(text: str | None) -> list[tuple[int, str, str]]:
    """(ordinal, kind, text) of a message's parts; an empty code block stays plain."""
    lines, parts, plain, i = (text or "").replace("\r\n", "\n").split("\n"), [], [], 0

    def flush():
        while plain and not plain[0].strip():
            plain.pop(0)
        while plain and not plain[-1].strip():
            plain.pop()
        if plain:
            parts.append(("plain", "\n".join(plain)))
        plain.clear()

    while i < len(lines):
        code = code_at(lines, i)
        if code and "\n".join(lines[i + 1 : code[1]]).strip():
            flush()
            parts.append(("code", "\n".join(lines[i + 1 : code[1]])))
            i = code[0]
            continue
        end = None if code else table_at(lines, i)
        if end:
            flush()
            parts.append(("table", "\n".join(lines[i:end])))
            i = end
            continue
        stop = code[0] if code else i + 1
        plain += lines[i:stop]
        i = stop
    flush()
    return [(n, k, t) for n, (k, t) in enumerate(parts)]


def parts_of(rows: DataFrame, key: str, text: str = "text") -> DataFrame:
    """key, ord, kind and part of every message's parts, worked on in Arrow batches."""

    def run(batches):
        for batch in batches:
            for name, body in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found = split_message(body.as_py())
                if found:
                    ord_, kind, part = zip(*found, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(found), pa.int64()), pa.array(ord_, pa.int32()), pa.array(kind, pa.string()), pa.array(part, pa.string())], [key, "ord", "kind", "part"])

    return rows.select(F.col(key).cast("long").alias(key), F.col(text).cast("string").alias("text")).mapInArrow(run, f"{key} long, ord int, kind string, part string")
