"""A segmented index: immutable segments of chunks and positional postings, tombstones, merges, stored sums.

A run writes one segment of the chunks it made and a table of the files whose older chunks are dead;
nothing else is written, so a run's cost is that of its changes. Segments carry their run's number, a
tombstone kills a file's rows in segments of lower numbers. Segments of like size that stand side by
side are merged (FAN at a time), which drops their dead rows, so that there are few and a row is
copied as often as the index has grown tenfold, about. A segment whose rows are all dead goes at once, and
what is left of one that is mostly dead is written anew. A run over one part of the files (by their
paths' hashes) leaves segments and tombstones of that part, which meet no other part's. A snapshot holds what is live: its segments,
tombstones, and the number of live chunks and the sum of their lengths.

Where an encoder is given, a segment holds its chunks' vectors, of length one. A text is encoded once:
vectors are looked up by the hash of the text in the segments there are, and only what is new is
encoded. That goes by parts of the hashes, one after the other, and of the texts only new ones are
shuffled, so that a part is all that lies in shuffle files. With a segment's dead rows their vectors go.

A segment's tables: chunks, by file; postings, one row a gram and block (a block is BLOCK chunks that a
task reads one after the other) with bounds (the number of chunks that hold the gram, the largest count
and the least length) and a body: numbers of those chunks in the block, counts, and places of the
gram in the folded texts, all as differences of few bytes. A block's first row, of the gram HEAD,
has its chunks' ids and lengths. A task makes the postings of its blocks where it reads their texts and
writes some blocks at a time sorted by gram, so that neither texts nor postings are shuffled or spilled, a
gram is read by pages of each file, and no gram is one task's work. Files and tasks grow with the segment.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import asdict, dataclass, field, replace
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.arrow import map_arrow
from ..functions.chunking import ORDINAL_BITS
from .manifest import written

GRAM = 3
#: Segments of one size that are merged, chunks of a block, blocks that are sorted together, grams that are named one by one to a scan.
FAN, BLOCK, TASK, NAMED = 4, 1024, 16, 100
#: Rows of a segment for each live one, from which on the live ones are written anew.
SPARSE = 4
#: The gram of a block's first row; rows of an Arrow batch.
HEAD, ROWS = -1, 10_000
#: Parts of the hashes at most, and chunks of a part at least.
PARTS, PART = 8, 32_768
CHUNKS = "chunk_id long, file_id long, ordinal int, start_line int, end_line int, text string, dl int, text_hash string"
BOUNDS = "gram long, block int, n long, most int, least int"
PACKED = f"{BOUNDS}, body binary"
OPEN = "gram long, block int, chunk_id long, dl int, places array<int>"
POSTINGS = f"{OPEN}, segment int"
BLOCKS = f"{BOUNDS}, segment int"
VECTORS = "chunk_id long, text_hash string, embedding array<float>"


def keys(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number, gram as a number (three code points of 21 bits) and place, for every gram of every text."""
    size = np.array([len(t) for t in texts], np.int64)
    letters = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    owner = np.repeat(np.arange(len(texts)), size)
    place = np.arange(len(letters)) - np.repeat(np.cumsum(size) - size, size)
    whole = place < np.repeat(size - (GRAM - 1), size)
    at = np.flatnonzero(whole)
    gram = (letters[at] << 42) | (letters[np.minimum(at + 1, len(letters) - 1)] << 21) | letters[np.minimum(at + 2, len(letters) - 1)]
    return owner[at], gram, place[at]


def cover(phrase: str) -> list[tuple[int, int]]:
    """Offset and number of grams that hold every letter of a folded phrase; a chunk holds the phrase where all stand so far apart."""
    _, gram, place = keys([phrase])
    return [(int(p), int(g)) for g, p in zip(gram, place, strict=True) if p % GRAM == 0 or p == len(phrase) - GRAM]


def among(grams: list[int]) -> Column:
    """Rows of the given grams; a few are named one by one, as a scan skips pages by equalities."""
    if len(grams) > NAMED:
        return F.col("gram").isin(*grams)
    return reduce(lambda a, b: a | b, (F.col("gram") == g for g in grams), F.lit(False))


@dataclass(frozen=True)
class Segment:
    """Where a segment's tables are, a number in the order of the runs, its size, the part of the files it is of (none: any), and how many of its rows are dead."""

    number: int
    chunks: str
    postings: str
    n: int
    rows: int
    blocks_n: int
    vectors: str = ""
    part: str = ""
    dead: int = 0

    @property
    def posted(self) -> str:
        """Where the postings are; a segment for vectors alone has none."""
        if not self.postings:
            raise ValueError(f"segment {self.number} has no postings")
        return self.postings


def reaches(number: int, part: str, segment: Segment) -> bool:
    """Whether a tombstone of that number and part may kill rows of the segment: parts of one division have no file in common."""
    apart = part and segment.part and part != segment.part and part.partition("/")[2] == segment.part.partition("/")[2]
    return number > segment.number and not apart


@dataclass(frozen=True)
class Snapshot:
    """The live index: segments by number, tombstones (number, path, part), live chunks and the sum of their lengths."""

    segments: tuple[Segment, ...] = ()
    tombstones: tuple[tuple[int, str, str], ...] = ()
    n: int = 0
    total: int = 0
    written: dict = field(default_factory=dict, compare=False)

    def as_json(self) -> dict:
        return {"segments": [asdict(s) for s in self.segments], "tombstones": [list(t) for t in self.tombstones], "n": self.n, "total": self.total}

    @staticmethod
    def from_json(x: dict) -> Snapshot:
        return Snapshot(tuple(Segment(**s) for s in x["segments"]), tuple((int(a), b, *part) if part else (int(a), b, "") for a, b, *part in x["tombstones"]), x["n"], x["total"])

    def _live(self, spark: SparkSession, rows: DataFrame, segment: Segment) -> DataFrame:
        """rows without those of files that a later run killed."""
        for number, path, part in self.tombstones:
            if reaches(number, part, segment):
                dead = spark.read.schema("file_id long").parquet(path)
                own = F.shiftright("chunk_id", ORDINAL_BITS)
                rows = rows.withColumn("_file", own).join(dead.withColumnRenamed("file_id", "_file"), "_file", "left_anti").drop("_file")
        return rows

    def _all(self, spark: SparkSession, parts: list[DataFrame], schema: str) -> DataFrame:
        out = spark.createDataFrame([], schema) if not parts else parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def chunks(self, spark: SparkSession) -> DataFrame:
        return self._all(spark, [self._live(spark, spark.read.schema(CHUNKS).parquet(s.chunks), s) for s in self.segments], CHUNKS)

    def postings(self, spark: SparkSession, wanted: dict[int, set[int]] | None = None, grams: list[int] | None = None) -> DataFrame:
        """gram, block, chunk_id, dl, places, segment; only the given grams' pages are read, and of a segment only the wanted blocks."""
        parts = []
        for s in self.segments:
            if wanted is not None and s.number not in wanted:
                continue
            rows = spark.read.schema(PACKED).parquet(s.posted)
            if grams is not None:
                rows = rows.where(among([HEAD, *grams]))
            if wanted is not None and len(wanted[s.number]) <= 500:
                rows = rows.where(F.col("block").isin(*wanted[s.number]))
            # A block's head comes before its grams.
            rows = rows.select("gram", "block", "n", "body").repartition("block").sortWithinPartitions("block", "gram")
            parts.append(self._live(spark, map_arrow(rows, unpacked, OPEN), s).withColumn("segment", F.lit(s.number)))
        return self._all(spark, parts, POSTINGS)

    def blocks(self, spark: SparkSession, grams: list[int] | None = None) -> DataFrame:
        """gram, block, n, most, least, segment; the numbers count dead rows too, so they are bounds."""
        parts = []
        for s in self.segments:
            rows = spark.read.schema(BOUNDS).parquet(s.posted)
            rows = rows.where(among(grams) if grams is not None else F.col("gram") != HEAD)
            parts.append(rows.withColumn("segment", F.lit(s.number)))
        return self._all(spark, parts, BLOCKS)

    def vectors(self, spark: SparkSession) -> DataFrame:
        """chunk_id, text_hash and embedding of live chunks, for segments that have vectors; a text without direction has an empty one."""
        return self._all(spark, [self._live(spark, spark.read.schema(VECTORS).parquet(s.vectors), s) for s in self.segments if s.vectors], VECTORS)

    @property
    def whole(self) -> bool:
        """Whether no row of a segment is dead."""
        return not any(reaches(number, part, s) for number, _, part in self.tombstones for s in self.segments)


def varints(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers from 0 on in groups of seven bits, the lowest first, and where each begins and the last ends."""
    size = np.ones(len(values), np.int64)
    for bits in range(7, 63, 7):
        more = values >= 1 << bits
        if not more.any():
            break
        size += more
    ends = np.concatenate([[0], np.cumsum(size)])
    out = np.empty(ends[-1], np.uint8)
    for i in range(size.max(initial=0)):
        own = size > i
        out[ends[:-1][own] + i] = (values[own] >> 7 * i & 127) | np.where(size[own] > i + 1, 128, 0)
    return out, ends


def integers(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of varints, and the place after each."""
    after = np.flatnonzero(data < 128) + 1
    if not len(after):
        return np.empty(0, np.int64), after
    first = np.concatenate([[0], after[:-1]])
    within = np.arange(len(data)) - np.repeat(first, after - first)
    return np.add.reduceat((data & 127).astype(np.int64) << 7 * within, first), after


def _spans(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places first, first + 1, ... of every span, one span after the other."""
    return np.repeat(first - np.cumsum(size) + size, size) + np.arange(size.sum())


def _sums(x: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Running sums within each span; spans are not empty and stand side by side."""
    total = np.cumsum(x)
    return total - np.repeat(total[first] - x[first], size)


def packed(block: int, ids: np.ndarray, dl: np.ndarray, texts: list[str]) -> pa.RecordBatch:
    """The head and the postings of a block's chunks, by ascending gram."""
    owner, gram, place = keys(texts)
    order = np.argsort(gram, kind="stable")
    owner, gram, place = owner[order], gram[order], place[order]
    new = np.concatenate([[True], gram[1:] != gram[:-1]])[: len(gram)]
    first = np.flatnonzero(new | np.concatenate([[True], owner[1:] != owner[:-1]])[: len(gram)])
    # Where a gram's chunks begin among the pairs of gram and chunk.
    head = np.flatnonzero(new[first])
    held, count = owner[first], np.diff(np.append(first, len(gram)))
    n, m = np.diff(np.append(head, len(first))), np.diff(np.append(first[head], len(gram)))
    number, step = held.copy(), place.copy()
    number[1:] -= np.where(new[first][1:], 0, held[:-1])
    again = np.ones(len(gram), bool)
    again[first] = False
    step[1:] -= np.where(again[1:], place[:-1], 0)
    # A gram's numbers, counts and places stand one after the other.
    size = 2 * n + m
    at = np.cumsum(size) - size
    values = np.empty(size.sum(), np.int64)
    values[_spans(at, n)], values[_spans(at + n, n)], values[_spans(at + 2 * n, m)] = number, count, step
    data, ends = varints(values)
    top = np.concatenate([ids.astype("<i8").view(np.uint8), dl.astype("<i4").view(np.uint8)])
    offsets = np.concatenate([[0], len(top) + ends[np.append(at, len(values))]]).astype(np.int32)
    body = pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(np.concatenate([top, data]))])
    most = np.maximum.reduceat(count, head) if len(head) else head
    least = np.minimum.reduceat(dl[held], head) if len(head) else head
    bounds = [np.append(z, x) for z, x in ((HEAD, gram[first][head]), (block, np.full(len(head), block)), (0, n), (0, most), (0, least))]
    return pa.RecordBatch.from_arrays([*(pa.array(x.astype(t)) for x, t in zip(bounds, ("i8", "i4", "i8", "i4", "i4"), strict=True)), body], ["gram", "block", "n", "most", "least", "body"])


def unpacked(batches):
    """gram, block, chunk_id, dl and places of rows of gram, block, n and body, where a block's head comes before its grams."""
    ids = dl = np.empty(0, np.int64)
    for batch in batches:
        gram, block, n = (batch.column(i).to_numpy() for i in range(3))
        heads = np.flatnonzero(gram == HEAD)
        cuts = [0, *heads, batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if a < b and gram[a] == HEAD:
                top = batch.column(3)[a].as_py()
                size = len(top) // 12
                ids, dl, a = np.frombuffer(top, "<i8", size), np.frombuffer(top, "<i4", size, 8 * size), a + 1
            for low in range(a, b, ROWS):
                own = slice(low, min(low + ROWS, b))
                bodies = batch.column(3).slice(low, own.stop - low).to_pylist()
                values, after = integers(np.frombuffer(b"".join(bodies), np.uint8))
                at = np.searchsorted(after, np.cumsum([0, *map(len, bodies[:-1])]), "right")
                size = n[own]
                first = np.cumsum(size) - size
                held, count = _sums(values[_spans(at, size)], first, size), values[_spans(at + size, size)]
                sums = np.add.reduceat(count, first)
                places = _sums(values[_spans(at + 2 * size, sums)], np.cumsum(count) - count, count)
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(count)).astype(np.int32)), pa.array(places.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([*(pa.array(x) for x in (np.repeat(gram[own], size), np.repeat(block[own], size), ids[held], dl[held])), lists], ["gram", "block", "chunk_id", "dl", "places"])


def posted(chunks: DataFrame, blocks: int) -> DataFrame:
    """The postings of chunks (chunk_id, text, dl) of about so many blocks, TASK blocks at a time sorted by gram."""
    rows, together = BLOCK, TASK

    def run(batches):
        # Blocks are numbered apart in each task.
        parts, made, number = [], [], TaskContext.get().partitionId() << 16

        def block():
            whole = pa.Table.from_batches(parts).combine_chunks()
            return packed(number, whole["chunk_id"].to_numpy(), whole["dl"].to_numpy(), whole["text"].to_pylist())

        def ordered():
            whole = pa.Table.from_batches(made).combine_chunks()
            yield from whole.take(np.argsort(whole["gram"].to_numpy(), kind="stable")).to_batches(ROWS)

        for batch in batches:
            at = 0
            while at < batch.num_rows:
                parts.append(batch.slice(at, rows - sum(p.num_rows for p in parts)))
                at += parts[-1].num_rows
                if sum(p.num_rows for p in parts) == rows:
                    made.append(block())
                    parts, number = [], number + 1
                if len(made) == together:
                    yield from ordered()
                    made = []
        if parts:
            made.append(block())
        if made:
            yield from ordered()

    own = chunks.select("chunk_id", F.lower("text").alias("text"), "dl")
    # A small segment is dealt to all cores.
    cores = chunks.sparkSession.sparkContext.defaultParallelism
    if blocks < together * cores:
        own = own.repartition(min(blocks, cores), "chunk_id")
    return map_arrow(own, run, PACKED)


def _written(run, df: DataFrame, name: str, rows: int = 0) -> str:
    path = run.path(name)
    written(df, path, rows)
    return path


def _held(run, chunks: DataFrame) -> str:
    """Where chunks (of CHUNKS' columns) are written, in files of some blocks, which all cores read apart."""
    return _written(run, chunks.sortWithinPartitions("chunk_id"), "chunks", BLOCK * TASK)


def _segment(run, spark: SparkSession, number: int, held: str, vectors: Callable[[DataFrame], Iterable[DataFrame]] | None = None, words: bool = True, part: str = "") -> tuple[Segment | None, int]:
    """The segment of the chunks held at a path and the sum of their lengths; none, if there are none. `vectors` gives the rows' vectors in parts."""
    own = spark.read.schema(CHUNKS).parquet(held)
    size = own.agg(F.count("*").alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("total")).first()
    if not size.n:
        return None, 0
    at, told = "", (0, 0)
    if words:
        at = _written(run, posted(own, -(-size.n // BLOCK)), "postings")
        told = tuple(spark.read.schema(BOUNDS).parquet(at).agg(F.coalesce(F.sum("n"), F.lit(0)), F.count_if(F.col("gram") == HEAD)).first())
    direction = run.path("vectors") if vectors else ""
    for rows in vectors(own) if vectors else ():
        written(rows, direction, more=True)
    return Segment(number, held, at, size.n, *told, direction, part), size.total


def shaped(made: DataFrame) -> DataFrame:
    """Chunks with their length in grams and the hash of their text."""
    return made.select("chunk_id", "file_id", "ordinal", "start_line", "end_line", "text", F.greatest(F.length("text") - (GRAM - 1), F.lit(0)).alias("dl"), F.sha2("text", 256).alias("text_hash"))


def _encoded(run, before: Snapshot, encode: Callable[[DataFrame], DataFrame], told: dict) -> Callable[[DataFrame], Iterator[DataFrame]]:
    """Vectors of new chunks: those of texts that any segment knows, dead or not, and of new texts from the encoder; by parts of the hashes."""
    pair = "text_hash string, embedding array<float>"

    def vectors(own: DataFrame) -> Iterator[DataFrame]:
        spark = own.sparkSession
        held = spark.createDataFrame([], pair)
        for s in before.segments:
            if s.vectors:
                held = held.unionByName(spark.read.schema(VECTORS).parquet(s.vectors).select("text_hash", "embedding"))
        parts = min(PARTS, -(-own.count() // PART))
        for i in range(parts):
            mine = F.pmod(F.xxhash64("text_hash"), F.lit(parts)) == i
            asked, known = own.where(mine).select("chunk_id", "text_hash"), held.where(mine)
            # A new text is that of its first chunk.
            first = asked.groupBy("text_hash").agg(F.min("chunk_id").alias("chunk_id")).join(known, "text_hash", "left_anti")
            at = {name: run.path(name) for name in ("new", "encoded")}
            written(first.select("chunk_id"), at["new"])
            new = spark.read.schema("chunk_id long").parquet(at["new"])
            if new.isEmpty():
                fresh = spark.createDataFrame([], pair)
            else:
                texts = own.where(mine).select("chunk_id", "text_hash", "text").join(new, "chunk_id", "left_semi")
                written(encode(texts.drop("chunk_id")).select("text_hash", F.transform("embedding", lambda x: x.cast("float")).alias("embedding")), at["encoded"])
                fresh = spark.read.schema(pair).parquet(at["encoded"])
                told["encoded"] += fresh.count()
            yield asked.join(known.unionByName(fresh).dropDuplicates(["text_hash"]), "text_hash").select("chunk_id", "text_hash", "embedding")
            for path in at.values():
                run.drop(path)

    return vectors


def apply(run, before: Snapshot, number: int, made: DataFrame, dead: DataFrame, encode: Callable[[DataFrame], DataFrame] | None = None, words: bool = True, then: Callable[[], None] | None = None, part: str = "") -> Snapshot:
    """The snapshot after a run: `made` are new chunks (CHUNKS' columns), `dead` the files whose older chunks go.

    `number` must be above all before. `encode` gives text_hash and embedding (of length one, or empty)
    for rows of text_hash and text. Without `words` the new chunks have no postings, for vector searches alone.
    `then` is called once `made` and `dead` are written and what they read is free to go. `part` names the
    part of the files (number/of how many) that all of `made` and `dead` is of.
    `written` tells the rows that this run wrote, before any merge.
    """
    spark = made.sparkSession
    # A run has two numbers: its tombstones' and that of what they leave of mostly dead segments, and its own segment's.
    killed, number = 2 * number, 2 * number + 1
    tombs, segments, lost = list(before.tombstones), list(before.segments), (0, 0)
    if segments:
        at = _written(run, dead.select("file_id").distinct(), "tombstones")
        gone = spark.read.schema("file_id long").parquet(at)
        met = [s for s in segments if reaches(killed, part, s)]
        rows = before._all(spark, [before._live(spark, spark.read.schema(CHUNKS).parquet(s.chunks).select("chunk_id", "file_id", "dl"), s).withColumn("segment", F.lit(s.number)) for s in met], "chunk_id long, file_id long, dl int, segment int")
        cut = {r.segment: r for r in rows.join(gone, "file_id", "left_semi").groupBy("segment").agg(F.count("*").alias("n"), F.sum("dl").alias("total")).collect()}
        if cut:
            lost = (sum(r.n for r in cut.values()), sum(r.total for r in cut.values()))
            tombs.append((killed, at, part))
            segments = [replace(s, dead=s.dead + cut[s.number].n) if s.number in cut else s for s in segments]
            segments = [s for s in segments if s.dead < s.n]
    told: dict = {"encoded": 0}
    held = _held(run, made)
    if then:
        then()
    own, total = _segment(run, spark, number, held, _encoded(run, before, encode, told) if encode else None, words, part)
    written = {"chunks": own.n if own else 0, "postings": own.rows if own else 0, "dead": lost[0], **told}
    sparse = [s for s in segments if (s.n - s.dead) * SPARSE <= s.n]
    if sparse:
        one = _joined(run, spark, Snapshot(tuple(sparse), tuple(tombs)), killed)
        segments = [s for s in segments if s not in sparse] + ([one] if one else [])
    segments += [own] if own else []
    out = Snapshot(tuple(segments), tuple(tombs), before.n - lost[0] + (own.n if own else 0), before.total - lost[1] + total)
    out = merged(run, spark, out)
    return Snapshot(out.segments, out.tombstones, out.n, out.total, written)


def _level(n: int) -> int:
    level = 0
    while n > BLOCK:
        n, level = n // FAN, level + 1
    return level


def _joined(run, spark: SparkSession, group: Snapshot, number: int) -> Segment | None:
    """What is live of a snapshot's segments as one segment."""
    parts = {s.part for s in group.segments}
    vectors = (lambda _: [group.vectors(spark)]) if all(s.vectors for s in group.segments) else None
    return _segment(run, spark, number, _held(run, group.chunks(spark)), vectors, all(s.postings for s in group.segments), parts.pop() if len(parts) == 1 else "")[0]


def merged(run, spark: SparkSession, snapshot: Snapshot) -> Snapshot:
    """Adjacent segments of one part and of like size as one, as long as there are FAN; tombstones that reach no segment go."""
    done = []
    for part in sorted({s.part for s in snapshot.segments}):
        segments = [s for s in snapshot.segments if s.part == part]
        while True:
            levels = [_level(s.n) for s in segments]
            at = next((i for i in range(len(segments) - FAN + 1) if max(levels[i : i + FAN]) == levels[i + FAN - 1] or len(set(levels[i : i + FAN])) == 1), None)
            if at is None:
                break
            group = segments[at : at + FAN]
            one = _joined(run, spark, Snapshot(tuple(group), snapshot.tombstones), group[-1].number)
            segments[at : at + FAN] = [one] if one else []
        done += segments
    done.sort(key=lambda s: s.number)
    tombs = tuple(t for t in snapshot.tombstones if any(reaches(t[0], t[2], s) for s in done))
    return Snapshot(tuple(done), tombs, snapshot.n, snapshot.total, snapshot.written)
