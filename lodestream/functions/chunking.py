"""Line-exact chunks over arrays of line lengths: a pure core, an Arrow map, and the same rules as SQL.

A chunk is a run of non-blank lines. One number tells the state before a line: the first line of the
open run. Running sums of lengths (each line counts one more for its break) give a run's size and the
place where the lines to be repeated begin, so a line is looked at once.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import map_arrow

# Characters of a chunk, of the repeated lines, of the least last chunk and of the longest line.
CHUNK, OVERLAP, LEAST, MOST = 800, 160, 100, 2000
_HEADING = re.compile(r"#{1,6}\s")
#: Chunks of an Arrow batch.
ROWS = 4096
#: Bits of a chunk's id that tell its place in the file.
ORDINAL_BITS = 24


def runs(lengths: list[int], headings: list[bool], chunk: int, overlap: int, most: int) -> tuple[list[tuple[int, int]], int]:
    """The closed runs (first line, line after the last; a line over `most` as a run of its own, marked by an equal pair) and the start of the open one."""
    total = [0, *accumulate(n + 1 for n in lengths)]
    closed, start = [], 0
    for i, n in enumerate(lengths):
        if n > most or headings[i] or total[i + 1] - total[start] > chunk:
            if start < i:
                closed.append((start, i))
                # The last line whose distance to here reaches the overlap; a shorter run stays whole.
                start = max(start, bisect_right(total, total[i] - overlap) - 1) if overlap > 0 else i
            if n > most:
                closed.append((i, i))
                start = i + 1
    return closed, start


def chunk_lines(lines: list[str], chunk: int = CHUNK, overlap: int = OVERLAP, least: int = LEAST, most: int = MOST) -> list[tuple[int, int, int, str]]:
    """(ordinal, first line, last line, text); lines are counted from 1 and blank ones dropped."""
    real = [(n, t) for n, t in enumerate(lines, 1) if t.strip()]
    closed, start = runs([len(t) for _, t in real], [_HEADING.match(t) is not None for _, t in real], chunk, overlap, most)
    text = lambda a, b: "\n".join(t for _, t in real[a:b])
    out = []
    for a, b in closed:
        if a < b:
            out.append((real[a][0], real[b - 1][0], text(a, b)))
        else:
            number, line = real[a]
            out += [(number, number, line[p : p + most]) for p in range(0, len(line), most)]
    if start < len(real):
        rest = (real[start][0], real[-1][0], text(start, len(real)))
        if out and len(rest[2]) < least:
            # A short end joins the chunk before it.
            first, last, before = out[-1]
            out[-1] = (min(first, rest[0]), max(last, rest[1]), before if rest[2] in before else before + "\n" + rest[2])
        else:
            out.append(rest)
    return [(i, *c) for i, c in enumerate(out)]


def chunks_of(files: DataFrame, key: str = "file_id", text: str = "text") -> DataFrame:
    """chunk_id, key, ordinal, start_line, end_line and text of every chunk, worked on in Arrow batches."""

    def run(batches):
        for batch in batches:
            names, found = [], []
            for name, body in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                own = chunk_lines((body.as_py() or "").splitlines())
                names += [name] * len(own)
                found += own
            for a in range(0, len(found), ROWS):
                ordinal, first, last, own = zip(*found[a : a + ROWS], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(names[a : a + ROWS], pa.int64()), *(pa.array(x, pa.int32()) for x in (ordinal, first, last)), pa.array(own, pa.string())], [key, "ordinal", "start_line", "end_line", "text"])

    rows = map_arrow(files.select(F.col(key).cast("long").alias(key), F.col(text).cast("string").alias("text")), run, f"{key} long, ordinal int, start_line int, end_line int, text string")
    return rows.select((F.shiftleft(key, ORDINAL_BITS) + F.col("ordinal")).alias("chunk_id"), key, "ordinal", "start_line", "end_line", "text")


#: The same rules for DuckDB: one step of the recursion takes one line of every document.
CHUNKS_SQL = r"""raw AS (SELECT doc_id AS file_id, string_split(CASE WHEN ends_with(text, chr(10)) THEN text[:-2] ELSE text END, chr(10)) AS ls FROM documents WHERE text <> ''),
real AS MATERIALIZED (SELECT file_id, list_filter(list_transform(range(1, len(ls) + 1), lambda i: {'n': i, 't': ls[i]}), lambda x: regexp_matches(x.t, '\S')) AS l FROM raw),
sums AS MATERIALIZED (SELECT file_id, l, len(l) AS n, list_transform(range(0, len(l) + 1), lambda i: CAST(coalesce(list_sum(list_transform(l[1:i], lambda x: length(x.t) + 1)), 0) AS BIGINT)) AS p FROM real WHERE len(l) > 0),
steps AS (
  SELECT file_id, 0 AS i, 0 AS s, -1 AS a, -1 AS b FROM sums
  UNION ALL
  SELECT file_id, i + 1, CASE WHEN big THEN i + 1 WHEN shut AND s < i THEN greatest(s, len(list_filter(p, lambda x: x <= p[i + 1] - 160)) - 1) ELSE s END,
    CASE WHEN shut AND s < i THEN s ELSE -1 END, CASE WHEN big THEN i ELSE -1 END
  FROM (SELECT st.file_id, st.i, st.s, u.p, u.n, length(u.l[st.i + 1].t) > 2000 AS big,
    length(u.l[st.i + 1].t) > 2000 OR regexp_matches(u.l[st.i + 1].t, '^#{1,6}\s') OR u.p[st.i + 2] - u.p[st.s + 1] > 800 AS shut
    FROM steps st JOIN sums u USING (file_id) WHERE st.i < u.n)),
parts AS (
  SELECT file_id, i - 1 AS pos, 0 AS piece, a AS x, i - 1 AS y, NULL AS line FROM steps WHERE a >= 0
  UNION ALL SELECT file_id, i - 1, k + 1, b, b + 1, substr(l[b + 1].t, k * 2000 + 1, 2000) FROM steps JOIN sums USING (file_id), range(0, 1000) r(k) WHERE b >= 0 AND k * 2000 < length(l[b + 1].t)
  UNION ALL SELECT file_id, n, 0, s, n, NULL FROM steps JOIN sums USING (file_id) WHERE i = n AND s < n),
texts AS (
  SELECT file_id, row_number() OVER (PARTITION BY file_id ORDER BY pos, piece) - 1 AS ordinal, count(*) OVER (PARTITION BY file_id) AS total, pos = n AS tail,
    CAST(l[x + 1].n AS INTEGER) AS start_line, CAST(l[y].n AS INTEGER) AS end_line, coalesce(line, array_to_string(list_transform(l[x + 1:y], lambda v: v.t), chr(10))) AS text
  FROM parts JOIN sums USING (file_id)),
short AS (SELECT * FROM texts WHERE tail AND total > 1 AND length(text) < 100),
chunks AS MATERIALIZED (
  SELECT t.file_id * 16777216 + t.ordinal AS chunk_id, t.file_id, CAST(t.ordinal AS INTEGER) AS ordinal, least(t.start_line, coalesce(s.start_line, t.start_line)) AS start_line, greatest(t.end_line, coalesce(s.end_line, t.end_line)) AS end_line,
    CASE WHEN s.text IS NULL OR contains(t.text, s.text) THEN t.text ELSE t.text || chr(10) || s.text END AS text
  FROM texts t LEFT JOIN short s ON s.file_id = t.file_id AND s.ordinal = t.ordinal + 1
  WHERE NOT (t.tail AND t.total > 1 AND length(t.text) < 100))"""
