"""Token ids as compressed binary shards: Re-Pair grammars with random-access decoding.

A shard holds a bounded run of documents in ascending order of their ids. Frequent pairs of
neighbouring symbols are replaced by nonterminals, round after round, until no pair is frequent (or
no symbol is free). A round takes the most frequent pairs and replaces their occurrences from left
to right. The first counts all pairs of the shard; as counts of old pairs only fall, later ones count
the pairs with a symbol of the round before, and those that were frequent and not taken. No pair
crosses the end of a document. The file keeps the rules, the length of each rule's expansion and
each document's place in the sequence, so one document, or a run of its ids, can be read without the
others: stored lengths tell which symbols to expand, and only these are.

File layout, little-endian: magic "RPR1"; seven u32: symbol width in bytes, first nonterminal,
rules, rounds, documents, symbols, ids; then rules (pairs of symbols), expansion lengths (u32 per
rule), the number of rules after each round (u32), symbols per document (u32), the symbols.

Defined results: a null or empty text is the end id alone; null ids come first; repeated rows are
kept, in the order of their texts; of pairs equally frequent the smaller is taken; a very long text
is a shard of its own; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .tokens import encoder, vocabulary

MAGIC = b"RPR1"
#: Pairs that a round replaces at most, and the least occurrences of a frequent one.
NEW, LEAST = 4096, 8
#: Ids of a shard; a longer document has a shard of its own.
SHARD = 1 << 20


def _slot(pairs: np.ndarray) -> np.ndarray:
    return ((pairs.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)).astype(np.int32)


def _counted(pairs: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """The frequent pairs and their counts."""
    run = np.sort(pairs)
    if not len(run):
        return run, np.empty(0, np.int64)
    edge = np.flatnonzero(np.concatenate([[True], run[1:] != run[:-1]]))
    count = np.diff(np.append(edge, len(run)))
    return run[edge[count >= least]], count[count >= least]


def compress(flat: np.ndarray, bounds: np.ndarray, new: int = NEW, least: int = LEAST) -> bytes:
    """The file of a shard of documents flat[bounds[i] : bounds[i + 1]]."""
    free = int(flat.max()) + 1 if len(flat) else 0
    wide = free > 60_000
    kind, key, half = (np.uint32, np.uint64, 32) if wide else (np.uint16, np.uint32, 16)
    top = (1 << 32) - 1 if wide else 1 << 16
    first, seq, last = free, flat.astype(kind), np.zeros(len(flat), bool)
    last[bounds[1:][np.diff(bounds) > 0] - 1] = True
    full = np.diff(bounds) > 0
    rules, levels = [], []
    fresh, waiting, table, large = 0, np.empty(0, key), np.zeros(1 << 20, np.int16), None
    while len(seq) > 1 and free < top:
        where = np.flatnonzero(~last[:-1])
        late = where[(seq[where] >= fresh) | (seq[where + 1] >= fresh)] if levels else where
        value = lambda at: (seq[at].astype(key) << key(half)) | seq[at + 1]  # noqa: B023, E731
        pairs = value(late)
        found, count = _counted(pairs, least)
        if len(waiting):
            # Pairs of old symbols that were left over, at most one of a slot at a time; they stand anywhere.
            late, pairs = where, value(where)
            old = waiting[np.isin(waiting, found, invert=True)]
            slots, at = np.unique(_slot(old), return_index=True)
            if len(at) > 1 << 15 and large is None:
                large = np.zeros(1 << 20, np.int32)
            # Places that 16 bits hold are looked up faster.
            places = large if len(at) > 1 << 15 else table
            places[slots] = np.arange(len(at))
            rule = places[_slot(pairs)]
            n = np.bincount(rule[old[at][rule] == pairs], minlength=len(at)) if len(at) else np.empty(0, np.int64)
            places[slots] = 0
            waiting = np.delete(old, at)
            found, count = np.concatenate([found, old[at][n >= least]]), np.concatenate([count, n[n >= least]])
        if not len(found):
            if not len(waiting):
                break
            continue
        order = np.lexsort((found, -count))
        # A rule is found by a hash of its pair; of pairs with one hash the most frequent is taken, the others wait.
        take = np.sort(np.unique(_slot(found[order]), return_index=True)[1])[: min(new, top - free)]
        chosen = found[order[take]]
        waiting = np.concatenate([np.delete(found[order], take), waiting])
        slots = _slot(chosen)
        table[slots] = np.arange(len(chosen))
        rule = table[_slot(pairs)]
        own = np.flatnonzero(chosen[rule] == pairs)
        at, rule = late[own], rule[own].astype(np.int64)
        table[slots] = 0
        # Of occurrences that overlap in a chain, the first, third, ... are replaced; the others lose a symbol to them.
        begins = np.concatenate([[True], np.diff(at) > 1])
        place = np.arange(len(at))
        once = (place - np.maximum.accumulate(np.where(begins, place, 0))) % 2 == 0
        at, rule = at[once], rule[once]
        seq[at] = free + rule
        last[at] = last[at + 1]
        keep = np.ones(len(seq), bool)
        keep[at + 1] = False
        seq, last = seq[keep], last[keep]
        rules.append(np.stack([chosen >> key(half), chosen & key((1 << half) - 1)], 1).astype(kind))
        fresh = free
        free += len(chosen)
        levels.append(free - first)
    pairs = np.concatenate(rules) if rules else np.empty((0, 2), kind)
    per_doc = np.zeros(len(bounds) - 1, np.uint32)
    per_doc[full] = np.diff(np.concatenate([[-1], np.flatnonzero(last)]))
    head = struct.pack("<7I", np.dtype(kind).itemsize, first, len(pairs), len(levels), len(per_doc), len(seq), len(flat))
    sizes = _expansions(first, pairs, np.array(levels, np.int64))[2][first:].astype("<u4")
    little = np.dtype(kind).newbyteorder("<")
    return b"".join([MAGIC, head, pairs.astype(little).tobytes(), sizes.tobytes(), np.array(levels, "<u4").tobytes(), per_doc.astype("<u4").tobytes(), seq.astype(little).tobytes()])


def _expansions(first: int, pairs: np.ndarray, levels: np.ndarray):
    """All symbols' expansions in one array, their starts and lengths; rules of a round use earlier symbols only."""
    flat, starts, sizes = np.arange(first, dtype=np.uint32), np.arange(first), np.ones(first, np.int64)
    at = 0
    for end in levels:
        both = pairs[at:end].astype(np.int64).ravel()
        more, size = common.ragged(flat, starts[both], sizes[both]), sizes[both].reshape(-1, 2).sum(1)
        starts = np.concatenate([starts, len(flat) + np.cumsum(size) - size])
        sizes = np.concatenate([sizes, size])
        flat, at = np.concatenate([flat, more]), end
    return flat, starts, sizes


class Shard:
    """A file read back: whole, or one document of it."""

    def __init__(self, blob: bytes):
        if blob[:4] != MAGIC:
            raise ValueError("not a Re-Pair shard")
        width, first, rules, rounds, docs, symbols, self.n_ids = struct.unpack_from("<7I", blob, 4)
        at, kind = 32, np.dtype(f"<u{width}")

        def read(n, kind):
            nonlocal at
            out = np.frombuffer(blob, kind, n, at)
            at += out.nbytes
            return out

        self.rules, self.sizes = read(2 * rules, kind).reshape(-1, 2), read(rules, "<u4")
        self.levels, self.per_doc, self.seq = read(rounds, "<u4").astype(np.int64), read(docs, "<u4"), read(symbols, kind)
        self.first, self.ends = first, np.cumsum(self.per_doc.astype(np.int64))

    def size_of(self, symbols: np.ndarray) -> np.ndarray:
        """Ids that each symbol stands for."""
        out = np.ones(len(symbols), np.int64)
        rule = symbols >= self.first
        out[rule] = self.sizes[symbols[rule].astype(np.int64) - self.first]
        return out

    def document(self, i: int, start: int = 0, length: int | None = None) -> np.ndarray:
        """The ids of document i, or of a run of them; symbols outside the run are passed over by their stored lengths."""
        part = self.seq[self.ends[i] - self.per_doc[i] : self.ends[i]]
        ends = np.cumsum(self.size_of(part))
        stop = int(ends[-1]) if length is None and len(ends) else min(start + (length or 0), int(ends[-1]) if len(ends) else 0)
        a, b = np.searchsorted(ends, start, "right"), np.searchsorted(ends, stop, "left") + 1
        skip, part = start - (int(ends[a - 1]) if a else 0), part[a:b]
        while (rule := part >= self.first).any():
            both = self.rules[np.where(rule, part.astype(np.int64) - self.first, 0)]
            part = np.stack([np.where(rule, both[:, 0], part), both[:, 1]], 1).ravel()[np.stack([np.ones(len(rule), bool), rule], 1).ravel()]
            ends = np.cumsum(self.size_of(part))
            a, b = np.searchsorted(ends, skip, "right"), np.searchsorted(ends, skip + stop - start, "left") + 1
            skip, part = skip - (int(ends[a - 1]) if a else 0), part[a:b]
        return part[skip : skip + stop - start].astype(np.uint32)

    def all(self) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and where each document begins."""
        flat, starts, lengths = _expansions(self.first, self.rules, self.levels)
        if (lengths[self.first :] != self.sizes).any():
            raise ValueError("a rule's stored length is wrong")
        size = lengths[self.seq]
        return common.ragged(flat, starts[self.seq], size), np.concatenate([[0], np.cumsum(size)])[np.concatenate([[0], self.ends])]


def write_shards(df: DataFrame, tokenizer: str | None = None, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", shard: int = SHARD, path: str | None = None) -> DataFrame:
    """Writes the shards in ascending order of the ids: task, task_start (the task's ids before it), doc_ids, ids, file."""
    tokenizer = tokenizer or vocabulary()
    kind = df.schema[id_col].dataType.simpleString()

    def row(task, at, docs, flat, bounds, kind):
        return pa.RecordBatch.from_arrays(
            [pa.array([task], pa.int64()), pa.array([at], pa.int64()), pa.array([docs], pa.list_(kind)), pa.array([len(flat)], pa.int64()), pa.array([compress(flat, bounds)], pa.binary())],
            ["task", "task_start", "doc_ids", "n_ids", "file"],
        )

    def run(batches):
        task, at, enc = TaskContext.get().partitionId(), 0, encoder(tokenizer)
        docs, parts, sizes, total, own = [], [], [], 0, None
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            own = ids.type
            for a, b in common.chunks(texts, 20_000_000):
                flat, bounds = common.with_end(*enc.encode_batch(texts.slice(a, b - a)), end_id)
                names = ids.slice(a, b - a).to_pylist()
                i = 0
                while i < b - a:
                    j = max(i + (not docs), int(np.searchsorted(bounds, bounds[i] + shard - total, "right")) - 1)
                    if j > i:
                        docs += names[i:j]
                        parts.append(flat[bounds[i] : bounds[j]])
                        sizes.append(np.diff(bounds[i : j + 1]))
                        total += len(parts[-1])
                    if j < b - a:
                        yield row(task, at, docs, np.concatenate(parts), np.concatenate([[0], np.cumsum(np.concatenate(sizes))]), own)
                        at += total
                        docs, parts, sizes, total = [], [], [], 0
                    i = j
        if docs:
            yield row(task, at, docs, np.concatenate(parts), np.concatenate([[0], np.cumsum(np.concatenate(sizes))]), own)

    rows = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    ordered = rows.repartitionByRange(F.col("doc_id").asc_nulls_first(), F.xxhash64("text")).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    shards = common.map_arrow(ordered, run, f"task long, task_start long, doc_ids array<{kind}>, n_ids long, file binary")
    if path is None:
        return common.materialise(shards, "repair")
    shards.write.parquet(path)
    return df.sparkSession.read.schema(shards.schema).parquet(path)


def read_shards(shards: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids (unsigned 32-bit) of every document."""
    bases = common.partition_bases(shards, "task", "n_ids", "base")
    placed = shards.join(F.broadcast(bases), "task").select("doc_ids", (F.col("base") + F.col("task_start")).alias("at"), "file")

    def run(batches):
        for batch in batches:
            for docs, at, blob in zip(batch.column(0), batch.column(1).to_pylist(), batch.column(2), strict=True):
                flat, bounds = Shard(blob.as_py()).all()
                for a in range(0, len(docs), 2000):
                    own = bounds[a : a + 2001]
                    yield pa.RecordBatch.from_arrays(
                        [docs.values.slice(a, len(own) - 1), pa.array(at + own[:-1]), pa.array(np.diff(own)), common.slices_of(flat[own[0] : own[-1]].astype("<u4"), own - own[0])],
                        ["doc_id", "start", "n_tokens", "ids"],
                    )

    kind = shards.schema["doc_ids"].dataType.elementType.simpleString()
    return common.map_arrow(placed, run, f"doc_id {kind}, start long, n_tokens long, ids binary")


def op3_token_output(spark, sf_dir: str) -> DataFrame:
    shards = write_shards(common.table(spark, sf_dir, "documents"))
    return read_shards(shards).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
